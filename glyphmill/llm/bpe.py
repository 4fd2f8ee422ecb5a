"""Operator 1: byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of the pattern are gathered per batch, distinct ones are bucketed by
length into padded matrices, and every row merges its leftmost minimum-rank
pair each round. Pair ranks are found in an open-addressing hash table held in
numpy arrays; after a round the merged column is compacted away. Rows that have
no pair left leave the matrix.

Cases: a null text is an empty text (no ids, hashes of the empty string); text
of any length is encoded whole; repeated rows and equal texts give equal
results, one per row; an empty table gives an empty result; only ``doc_id`` and
``text`` are read, so other columns can't clash; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphmill.llm.common import release_memory, slices, without_collection

NONE = np.int64(1 << 40)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)
LONG_PIECE = 128
CACHE_ENTRIES = 120_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> rank, as a linear-probing hash table in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pad = max(ranks.values(), default=0) + 1
        self.base = np.uint64(self.pad + 1)
        keys = np.array(left, np.uint64) * self.base + np.array(right, np.uint64)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.shift = np.int64(size - 1), np.uint64(65 - size.bit_length())
        self.keys, self.ranks = np.full(size, EMPTY), np.full(size, NONE)
        todo, step = np.arange(len(keys)), 0
        values = np.array(rank, np.int64)
        while todo.size:
            slot = (self._slot(keys[todo]) + step) & self.mask
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[todo[free]]  # of several in one slot the last stays
            placed = free & (self.keys[slot] == keys[todo])
            self.ranks[slot[placed]] = values[todo[placed]]
            todo, step = todo[~placed], step + 1
        self.probes = step + 1
        self.least = np.full(self.pad + 1, NONE)  # least rank of a pair that a token is part of
        np.minimum.at(self.least, np.array(left, np.int64), values)
        np.minimum.at(self.least, np.array(right, np.int64), values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * self.base + right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE)
        todo = np.arange(keys.size)
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at != EMPTY)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out


class BytePairEncoder:
    """Encoder and decoder for one vocabulary and pattern; ids equal the library's ``encode_ordinary``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.vocab: list[bytes] = [b""] * self.pairs.pad
        for token, r in ranks.items():
            self.vocab[r] = token
        self.decimal = [str(i) for i in range(self.pairs.pad)]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # the same by the word behind a space, or behind a NUL at the start of a text
        # Where a single space stands between two other characters, the pattern always starts anew.
        self.starts_anew = regex.compile(r"(?<=\S)(?= \S)")
        self.other_space = re.compile("[\t\r\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.by_space = all(pattern.count(x) for x in (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+"))

    def merge_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of byte strings of up to about equal length."""
        out: list[list[int]] = [[]] * len(rows)
        width = max(map(len, rows))
        lengths = np.array([len(x) for x in rows])
        flat = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        tok = np.full((len(rows), width + 1), self.pairs.pad, np.int64)
        tok[np.arange(width + 1)[None, :] < lengths[:, None]] = flat
        rank = np.full(tok.shape, NONE)
        rank[:, :-1] = self.pairs.lookup(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(rows), width)
        who = np.arange(len(rows))
        while True:
            at = rank.argmin(axis=1)
            each = np.arange(len(who))
            best = rank[each, at]
            done = best == NONE
            if done.any():
                pad = self.pairs.pad
                for k in np.flatnonzero(done):
                    out[who[k]] = [x for x in tok[k].tolist() if x != pad]
                live = ~done
                who, tok, rank, at, best = who[live], tok[live], rank[live], at[live], best[live]
                each = np.arange(len(who))
            if not len(who):
                return out
            tok[each, at] = best
            keep = np.ones(tok.shape, bool)
            keep[each, at + 1] = False
            tok, rank = tok[keep].reshape(len(who), -1), rank[keep].reshape(len(who), -1)
            if tok.shape[1] == 1:
                rank[:] = NONE
                continue
            last = at + 1 < tok.shape[1]
            rank[each, at] = NONE
            rank[each[last], at[last]] = self.pairs.lookup(best[last], tok[each[last], at[last] + 1])
            prior = at > 0
            rank[each[prior], at[prior] - 1] = self.pairs.lookup(tok[each[prior], at[prior] - 1], best[prior])

    def merge_long(self, data: bytes) -> list[int]:
        """The same for one long byte string.

        All occurrences of the minimum rank merge in one round where no pair with
        the new token has a lower rank, which gives the same ids as one by one from the left.
        """
        tok = self.byte_ids[np.frombuffer(data, np.uint8)]
        while tok.size > 1:
            rank = self.pairs.lookup(tok[:-1], tok[1:])
            low = rank.min()
            if low == NONE:
                break
            at = np.flatnonzero(rank == low)
            if self.pairs.least[low] > low:
                run = np.r_[True, np.diff(at) > 1]
                first = at[np.flatnonzero(run)][np.cumsum(run) - 1]
                at = at[(at - first) % 2 == 0]
            else:
                at = at[:1]
            tok[at] = low
            tok = np.delete(tok, at + 1)
        return tok.tolist()

    def encode_pieces(self, pieces: set[bytes]) -> dict[bytes, list[int]]:
        out, buckets = {}, {}
        for p in pieces:
            r = self.ranks.get(p)
            if r is not None:
                out[p] = [r]
            elif len(p) > LONG_PIECE:
                out[p] = self.merge_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(p)
        for rows in buckets.values():
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                out.update(zip(part, self.merge_rows(part)))
        return out

    def plain(self, text: str) -> bool:
        """Whether all white space is line feeds and single spaces between other characters (and there is no NUL)."""
        return bool(text) and self.by_space and text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and " \n" not in text and "\n " not in text and not self.other_space.search(text)

    def learn(self, chunks: dict[str, str], into: dict[str, bytes]) -> None:
        """Ids of chunks by their keys."""
        pieces = {key: [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for key, c in chunks.items()}
        known = self.encode_pieces({p for ps in pieces.values() for p in ps})
        for key, ps in pieces.items():
            into[key] = array("I", [i for p in ps for i in known[p]]).tobytes()

    @without_collection()
    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words of plain texts are coded in Arrow, and their ids gathered; other texts are cut where the pattern starts anew."""
        for cache in (self.chunks, self.words):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        plain = [k for k, t in enumerate(texts) if self.plain(t)]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        if plain:
            split = pc.split_pattern(pa.array(["\x00" + texts[k] for k in plain], pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            unique = coded.dictionary.to_pylist()
            self.learn({w: w[1:] if w[0] == "\x00" else " " + w for w in unique if w not in self.words}, self.words)
            found = [self.words[w] for w in unique]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            codes = coded.indices.to_numpy()
            count, first = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
            ends = np.cumsum(count)
            ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
            cuts = ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1]
            for k, part in zip(plain, np.split(ids, cuts[:-1])):
                out[k] = part
        odd = {k: self.starts_anew.split(texts[k]) if self.by_space else [texts[k]] for k in sorted(set(range(len(texts))).difference(plain)) if texts[k]}
        self.learn({c: c for chunks in odd.values() for c in chunks if c not in self.chunks}, self.chunks)
        for k, chunks in odd.items():
            out[k] = np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), "<u4")
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per Python worker, vocabulary and pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids, and return counts and digests (and the ids, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for rows in slices(batches, 512):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            counts, hashes, back, ids_out = [], [], [], []
            for ids in enc.encode_batch(texts):
                ids = ids.tolist()
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    ids_out.append(ids)
            cols = [rows.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        enc.chunks.clear(), enc.words.clear()  # workers live on for other operators' tasks
        release_memory()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
