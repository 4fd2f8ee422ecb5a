"""Operator 5: benchmark decontamination by Wu-Manber multi-pattern search.

Symbols are words. Patterns are the windows of the benchmark items; those of
one length share a shift table over blocks of two words (one word for patterns
of one word): the table tells how far the search may move on, a zero sends it to
the bucket of patterns whose suffix block hashes alike, and words are compared
directly. All windows of full items have one length, so there is one table for
them and one for each shorter length that occurs.

The benchmark is read in blocks of bounded size, each broadcast and searched
in its own pass over what the passes before found; so its size has no limit.

Cases: null or wordless texts have no words and are clean; items without words
never occur; items with equal texts are reported each; repeated documents give a
row each; texts of any length are searched whole; an empty benchmark leaves all clean;
null item ids are searched but can't be named, so they count as hit words only; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from glyphmill.llm.common import nullable, packed, slices, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: ASCII letters and digits and all bytes of other characters stay, letters in lower case; the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search for word sequences of one length in a document of word codes."""

    def __init__(self, length: int):
        self.m, self.b = length, min(2, length)
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], list[int]]] = {}

    def add(self, pattern: tuple[int, ...], item: int, base: int) -> None:
        for end in range(self.b, self.m + 1):
            key = self._block(pattern, end - 1, base)
            self.shift[key] = min(self.shift.get(key, self.m), self.m - end)
        items = self.bucket.setdefault(self._block(pattern, self.m - 1, base), {}).setdefault(pattern, [])
        if item not in items:
            items.append(item)

    def _block(self, codes, at: int, base: int) -> int:
        return codes[at] if self.b == 1 else codes[at - 1] * base + codes[at]

    def search(self, codes: list[int], blocks: list[int], hit: bytearray, items: set[int]) -> None:
        """``blocks[i]`` is the block that ends at word ``i``."""
        m, skip = self.m, self.m - self.b + 1
        at, n, shift = m - 1, len(codes), self.shift.get
        while at < n:
            move = shift(blocks[at], skip)
            if move:
                at += move
                continue
            found = self.bucket[blocks[at]].get(tuple(codes[at - m + 1 : at + 1]))
            if found:
                hit[at - m + 1 : at + 1] = b"\x01" * m
                items.update(found)
            at += 1


class Patterns:
    """All windows of one block of items."""

    def __init__(self, items: list[bytes], window: int):
        self.codes: dict[bytes, int] = {}
        split = [words(t) for t in items]
        for ws in split:
            for w in ws:
                self.codes.setdefault(w, len(self.codes) + 1)
        self.base = len(self.codes) + 1
        self.tables: dict[int, WuManber] = {}
        for item, ws in enumerate(split):
            m = min(window, len(ws))
            if m:
                code = [self.codes[w] for w in ws]
                searcher = self.tables.setdefault(m, WuManber(m))
                for k in range(len(code) - m + 1):
                    searcher.add(tuple(code[k : k + m]), item, self.base)

    def search(self, ws: list[bytes], hit: bytearray) -> set[int]:
        items: set[int] = set()
        get = self.codes.get
        codes = [get(w, 0) for w in ws]
        base, pairs = self.base, None
        for m, searcher in self.tables.items():
            if searcher.b == 1:
                searcher.search(codes, codes, hit, items)
            elif len(codes) >= m:
                if pairs is None:
                    pairs = [0]
                    pairs += [a * base + b for a, b in zip(codes, codes[1:])]
                searcher.search(codes, pairs, hit, items)
        return items


_built: dict[str, Patterns] = {}


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """The benchmark in blocks of about ``block_bytes``, dealt by a hash of id and text."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text")
        ids, texts = [], []
        for r in part.toLocalIterator():
            ids.append(r["item_id"]), texts.append(r["text"].encode())
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_hit, items): ``row`` has the columns of ``docs``, ``items`` the sorted distinct ids found, without nulls."""
    spark = docs.sparkSession
    now = packed(docs).withColumns({"hit": F.lit(None).cast("binary"), "items": F.array().cast("array<bigint>")})
    schema = StructType([StructField("row", nullable(docs.schema)), StructField("hit", BinaryType()), StructField("items", ArrayType(LongType()))])
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for ids, texts in _blocks(items, block_bytes):
        if not texts:
            continue
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, texts, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            key, ids, texts, window = held.value
            if key not in _built:
                _built.clear()
                _built[key] = Patterns(texts, window)
            search = _built[key].search
            for rows in slices(batches):
                hits, named = [], []
                for t, old, was in zip(text_bytes(rows.column(0).field("text")), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                    ws = words(t)
                    hit = bytearray(old) if old else bytearray(len(ws))
                    found = search(ws, hit)
                    hits.append(bytes(hit) if found or old else None)
                    named.append(sorted({*was, *(ids[k] for k in found if ids[k] is not None)}) if found else was)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(hits, pa.binary()), pa.array(named, pa.list_(pa.int64()))], names=["row", "hit", "items"])

        now = now.mapInArrow(run, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            n = [len(words(t)) for t in text_bytes(rows.column(0).field("text"))]
            hit = [sum(h) if h else 0 for h in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), rows.column(2)], names=["row", "n_words", "n_hit", "items"])

    out = StructType([StructField("row", nullable(docs.schema)), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(LongType()))])
    return now.mapInArrow(count, out)


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
