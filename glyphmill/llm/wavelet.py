"""Operator 4: token ids in succinct shard files (wavelet matrices).

Documents are range-partitioned and sorted by ``doc_id``; each partition
encodes its texts and cuts the ids into shards. A shard is a wavelet matrix:
one bit-plane per bit of the largest id, from the highest, each plane stably
sorting the ids by that bit. With rank and select over the planes a shard
answers access, count and occurrence queries without being unpacked. Shards
are written as rows of compressed Parquet files in the shared folder, so they
live wherever Spark can write, and are read back from there.

Cases: a null text is empty (only the end id); a null ``doc_id`` sorts first
and stays null; repeated ids keep one entry per row, in an unspecified order
among themselves; a text of any length stays in one shard, so a shard holds at
least one document; an empty table gives no file rows and an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import save, slices, without_collection

SHARD_TOKENS = 1 << 18
CACHE_ENTRIES = 600_000
SHARD_SCHEMA = "part int, shard int, first bigint, n_docs int, n_tokens bigint, doc_ids binary, null_ids binary, lengths binary, bits int, planes binary"


class WaveletMatrix:
    """Bit-planes over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: np.ndarray):
        self.n, self.planes = n, planes  # planes: (bits, bytes) packed
        self._sums: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if ids.size else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = np.empty((bits, (ids.size + 7) // 8), np.uint8)
        for level in range(bits):
            one = (x & x.dtype.type(1 << (bits - 1 - level))) != 0
            planes[level] = np.packbits(one)
            x = np.concatenate([x.take(np.flatnonzero(~one)), x.take(np.flatnonzero(one))])
        return cls(ids.size, planes)

    def to_bytes(self) -> bytes:
        return self.planes.tobytes()

    @classmethod
    def from_bytes(cls, n: int, bits: int, data: bytes) -> WaveletMatrix:
        return cls(n, np.frombuffer(data, np.uint8).reshape(bits, -1))

    def plane(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the lowest plane up."""
        bits = len(self.planes)
        x = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = self.plane(level)
            zeros = self.n - int(np.count_nonzero(one))
            up = np.empty_like(x)
            up[np.flatnonzero(~one)] = x[:zeros]
            up[np.flatnonzero(one)] = x[zeros:] | x.dtype.type(1 << (bits - 1 - level))
            x = up
        return x.astype(np.uint32)

    def _rank(self) -> list[np.ndarray]:
        if self._sums is None:
            self._sums = [np.r_[0, np.cumsum(self.plane(k))] for k in range(len(self.planes))]
        return self._sums

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for ones in self._rank():
            bit = int(ones[i + 1] - ones[i])
            value = value << 1 | bit
            i = int(self.n - ones[-1] + ones[i]) if bit else int(i - ones[i])
        return value

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``start`` to ``end`` (exclusive)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return max(0, b - a)

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        for level, ones in enumerate(self._rank()):
            if token >> (bits - 1 - level) & 1:
                zeros = self.n - ones[-1]
                a, b = int(zeros + ones[a]), int(zeros + ones[b])
            else:
                a, b = int(a - ones[a]), int(b - ones[b])
        return a, b

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``, or -1."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at, bits = a + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            ones = self._rank()[level]
            if token >> (bits - 1 - level) & 1:
                at = int(np.searchsorted(ones, at - (self.n - ones[-1]) + 1)) - 1
            else:
                at = int(np.searchsorted(np.arange(self.n + 1) - ones, at + 1)) - 1
        return at


class WordEncoder:
    """The tokenizers library over distinct words.

    The library's pre-tokenizer never joins across white space and its
    normaliser works on each side of it alone, so ids of words, joined, are the
    ids of the text. Texts of Latin-1 characters are put in lower case first, and
    where they have no apostrophe and points and commas stand only behind letters and
    digits, those are words of their own. New words of such letters need no
    normaliser; they are encoded as one text and parted where a token ends a
    word. Tests compare all this with whole-text encoding.
    """

    #: a letter or digit, a point or comma, white space that is cut at, an apostrophe, any other
    kinds = bytes(97 if chr(c).isalnum() else 112 if c in (44, 46) else 115 if c in (10, 32) else 113 if c == 39 else 111 for c in range(256))

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer.from_file(path)  # ASCII letters stand for their own bytes
        self.ascii.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.fast = "encode_batch_fast" if hasattr(self.tok, "encode_batch_fast") else "encode_batch"
        self.end = array("I", [end_id]).tobytes()
        self.words: dict[str, bytes] = {"\n": self.end}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def prepare(self, text: str) -> str:
        """Words with single characters between them to cut at, and the end as a word of its own (a line feed, which no other word can be)."""
        try:
            kinds = text.encode("latin-1").translate(self.kinds)
        except UnicodeEncodeError:
            kinds = b"q"
        if b"q" not in kinds:
            text = text.lower()
            if not (kinds[:1] == b"p" or any(x in kinds for x in (b"op", b"sp", b"pp", b"pa", b"po"))):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.replace("\n", " ") + " \n"

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha() and w.islower()]
        self._learn_letters([w for w in letters if w.isascii()], self.ascii)
        self._learn_letters([w for w in letters if not w.isascii() and max(w) <= "\xff"], self.lean)
        rest = [w for w in new if w not in self.words]
        for w, e in zip(rest, getattr(self.tok, self.fast)(rest, add_special_tokens=False)):
            self.words[w] = array("I", e.ids).tobytes()

    def _learn_letters(self, plain: list[str], tokenizer) -> None:
        """Words of letters as one text; each ends with the one token that ends a word."""
        if not plain:
            return
        ids = np.array(getattr(tokenizer, self.fast)([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("a word of letters didn't end with one word-ending token")
        data, a = ids.tobytes(), 0
        for w, b in zip(plain, (4 * ends).tolist()):
            self.words[w] = data[a:b]
            a = b

    @without_collection()
    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id: words are coded in Arrow, and their ids gathered."""
        if len(self.words) > CACHE_ENTRIES:
            self.words = {"\n": self.end}
        if not texts:
            return []
        split = pc.split_pattern(pa.array([self.prepare(t) for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        self._learn([w for w in unique if w not in self.words])
        found = [self.words[w] for w in unique]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        count, first = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(count)
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
        cuts = ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1]
        return np.split(ids, cuts[:-1])


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = 12 << 20) -> Iterator[pa.Table]:
    """Batches put together up to some megabytes: the more text, the fewer words are looked up again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def _shard(part: int, number: int, first: int, docs: list[int | None], ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids)
    matrix = WaveletMatrix.build(flat)
    return {
        "part": part, "shard": number, "first": first, "n_docs": len(docs), "n_tokens": flat.size,
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "null_ids": bytes(d is None for d in docs),
        "lengths": np.array([len(x) for x in ids], "<u4").tobytes(), "bits": len(matrix.planes), "planes": matrix.to_bytes(),
    }


def write_shards(docs: DataFrame, path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode in ``doc_id`` order and write the shard files; returns the table that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), _encoder(path, end_id)
        number, first, size = 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, first, size
            row = _shard(part, number, first, doc_ids, ids)
            number, first, size = number + 1, first + row["n_tokens"], 0
            doc_ids.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("lengths", pa.binary()), ("bits", pa.int32()), ("planes", pa.binary())])
        for rows in gathered(batches):
            keys = rows.column(0).to_pylist()
            for key, one in zip(keys, enc.encode_batch([t or "" for t in rows.column(1).to_pylist()])):
                if ids and size + len(one) > shard_tokens:
                    yield flush()
                doc_ids.append(key), ids.append(one)
                size += len(one)
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return save(ordered.mapInArrow(run, SHARD_SCHEMA), "wavelet-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document from the shard files: start, length and crc32 of its ids.

    The driver sees one count per written partition, from which each partition's start follows.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1):
            r = rows.to_pylist()[0]
            ids = WaveletMatrix.from_bytes(r["n_tokens"], r["bits"], r["planes"]).decode().astype("<u4")
            lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            nulls = np.frombuffer(r["null_ids"], np.uint8).view(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=nulls), pa.array(starts[r["part"]] + r["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return shards.select("part", "first", "n_tokens", "doc_ids", "null_ids", "lengths", "bits", "planes").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of a token per shard, counted on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1):
            r = rows.to_pylist()[0]
            n = WaveletMatrix.from_bytes(r["n_tokens"], r["bits"], r["planes"]).count(token)
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "shard": r["shard"], "n": n}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]))

    return shards.select("part", "shard", "n_tokens", "bits", "planes").mapInArrow(run, "part int, shard int, n bigint")
