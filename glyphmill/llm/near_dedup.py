"""Operator 6: near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Sets get minwise signatures; equal
sets collapse to one class, whose copies follow it. Trees then branch the classes: a
node chooses signature coordinates by a hash of its own path, and a class goes to the
child that its token at that coordinate names. Nodes of at most ``leaf``
classes are compared exhaustively on signatures; larger ones branch again, and what
is still large at the last level is compared block against block. Independent
trees repeat this until the target recall.

What the leaves find are loose links, with a margin below the threshold that
signatures practically never miss. Their components are compared on full sets,
within one task where they are small and leaf by leaf where they aren't, and
only confirmed links count. Leaves emit spanning links of their clusters, never all pairs.

Recall at similarity 0.8: a link is missed by a root of one coordinate with
probability 0.2, so by all 10 trees of one level with 1e-7; by three levels of
branching 1.25 one tree misses it with 0.42, ten with 2e-4. The margin misses 1e-4.

Cases: texts without words, and null texts, have the empty set and are linked with
nothing; texts of fewer words than a shingle are one shingle; repeated rows are copies of each
other; rows of one ``doc_id`` are judged each by its text; a null ``doc_id`` takes part, and its component is null (and the row
kept) only where no other id is reachable; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import components, drop_saved, group_ids, key_groups, release_memory, save, slices, spanning, text_bytes

COORDINATES = 64
SEED = 20240229
_rng = np.random.default_rng(SEED)
_MUL = (_rng.integers(0, 1 << 62, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_POWERS = _rng.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space that parts words, for splitting: space and bytes 9 to 13; A-Z are put in lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


class Shingler:
    """64-bit hashes of word shingles; word hashes are kept between documents."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes | None) -> list[bytes]:
        return [w for w in text.translate(_FOLD).split(b" ") if w] if text else []

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        ws = self.words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        codes = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        k = min(self.width, len(ws))
        mixed = np.full(len(ws) - k + 1, k, np.uint64)
        for j in range(k):
            part = codes[j : len(ws) - k + 1 + j] * _POWERS[j % 16]
            mixed = (mixed ^ (part ^ (part >> np.uint64(29)))) * _POWERS[(j + 7) % 16]
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise signature of 32-bit values."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, shingles.size, 4096):
        part = shingles[k : k + 4096, None] * _MUL
        part += _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_shinglers: dict[int, Shingler] = {}


def _shingler(width: int) -> Shingler:
    return _shinglers.setdefault(width, Shingler(width))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row; empty sets have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler(width)
        for rows in slices(batches):
            n, digests, sigs = [], [], []
            for t in text_bytes(rows.column(1)):
                x = s.shingles(t)
                n.append(x.size)
                digests.append(_digest(x) if x.size else None)
                sigs.append(signature(x).tobytes() if x.size else None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])
        s.known.clear()  # workers live on for other operators' tasks
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sig binary")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, digest, sig, shingles) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler(width)
        for rows in slices(batches):
            sets = [s.shingles(t) for t in text_bytes(rows.column(1))]
            cols = [pa.array([f(x) for x in sets], pa.binary()) for f in (_digest, lambda x: signature(x).tobytes(), np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *cols], names=["id", "digest", "sig", "shingles"])
        s.known.clear()

    return texts.select("id", "text").mapInArrow(run, "id bigint, digest binary, sig binary, shingles binary")


def _token(sig: Column, coordinate: Column) -> Column:
    """The four bytes of a signature at a coordinate."""
    return sig.substr(coordinate * 4 + 1, F.lit(4))


def _children(node: Column, sig: Column) -> Column:
    """Keys of the children that a member of ``node`` goes to: one by the first chosen coordinate, in a quarter of nodes another by a second."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
    key = lambda c: F.xxhash64(node, c, _token(sig, c))
    more = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(4)) == 0
    return F.when(more, F.array(key(first), key(second))).otherwise(F.array(key(first)))


def _roots(sig: Column, trees: int) -> Column:
    """Node keys of the first level: each tree has a coordinate of its own."""
    order = np.random.default_rng(SEED + 1).permutation(COORDINATES)
    return F.array(*[F.xxhash64(F.lit(t), _token(sig, F.lit(int(order[t % COORDINATES])))) for t in range(trees)])


def leaves(classes: DataFrame, trees: int, leaf: int, levels: int, tag: str = "near") -> DataFrame:
    """(node, id) of all nodes with 2 to ``leaf`` members; what is larger at the last level is dealt into pairs of blocks."""
    found: list[DataFrame] = []
    now = classes.select("id", F.explode(_roots(F.col("sig"), trees)).alias("node"))
    for level in range(levels):
        sizes = now.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        placed = save(now.join(sizes, "node").select("node", "id", "n"), f"{tag}-level")
        found.append(placed.where(F.col("n") <= leaf).select("node", "id"))
        large = placed.where(F.col("n") > leaf)
        if not large.take(1):
            break
        if level + 1 < levels:
            now = large.join(classes, "id").select("id", F.explode(_children(F.col("node"), F.col("sig"))).alias("node")).distinct()
        else:
            blocks = F.ceil(2 * F.col("n") / leaf).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            dealt = large.select("node", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            found.append(dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _similar(sigs: np.ndarray, i: int, among: np.ndarray | slice, least: int) -> np.ndarray:
    return np.count_nonzero(sigs[among] == sigs[i], axis=1) >= least


def loose_links(placed: DataFrame, classes: DataFrame, estimate: float) -> DataFrame:
    """Spanning links (a, b) of clusters of like signatures in each leaf."""
    least = int(np.ceil(estimate * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()
        for group in key_groups(batches, "node"):
            k = group.num_rows
            if k < 2:
                continue
            ids = group["id"].to_numpy()
            sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.int32).reshape(k, COORDINATES)
            label = np.arange(k)
            for i in range(k - 1):
                hit = np.flatnonzero(_similar(sigs, i, slice(i + 1, k), least)) + i + 1
                if hit.size:
                    ls = np.unique(np.r_[label[i], label[hit]])
                    if ls.size > 1:
                        label[np.isin(label, ls[1:])] = ls[0]
            links += [x for x in spanning(ids, label) if x not in seen]
            if len(links) > 5000:
                yield _pairs(links)
                seen = set(links)
                links = []
        yield _pairs(links)

    return group_ids(placed.join(classes, "id").select("node", "id", "sig"), run, "a bigint, b bigint", "node").distinct()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def confirm(ids: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, estimate: float) -> list[tuple[int, int]]:
    """Spanning links of the confirmed clusters of one group: 100 * intersection >= percent * union on full sets.

    Likely pairs are checked first; pairs of one cluster need no check.
    """
    k = len(ids)
    label = np.arange(k)
    hashed: dict[int, frozenset] = {}

    def items(i: int) -> frozenset:
        if i not in hashed:
            if len(hashed) > 5000:
                hashed.clear()
            hashed[i] = frozenset(sets[i].tolist())
        return hashed[i]

    sizes = np.array([s.size for s in sets])
    high = int(np.ceil(min(1.0, percent / 100 + 0.04) * COORDINATES))
    low = int(np.ceil(estimate * COORDINATES))
    for floor, ceiling in ((high, COORDINATES + 1), (low, high)):
        for i in range(k - 1):
            same = np.count_nonzero(sigs[i + 1 :] == sigs[i], axis=1)
            rest = slice(i + 1, k)
            fits = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
            hit = np.flatnonzero((same >= floor) & (same < ceiling) & fits & (label[rest] != label[i]))
            for j in (hit[np.argsort(-same[hit], kind="stable")] + i + 1).tolist():
                if label[i] == label[j]:
                    continue
                common = len(items(i) & items(j))
                if 100 * common >= percent * (int(sizes[i] + sizes[j]) - common):
                    a, b = sorted((label[i], label[j]))
                    label[label == b] = a
    return spanning(ids, label)


def confirmed_links(groups: DataFrame, percent: int, estimate: float) -> DataFrame:
    """Confirmed spanning links of rows (node, id, sig, shingles), group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, "node", 512):
            k = group.num_rows
            if k > 1:
                sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.int32).reshape(k, COORDINATES)
                sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
                links = confirm(group["id"].to_numpy(), sigs, sets, percent, estimate)
                if links:
                    yield _pairs(links)

    return group_ids(groups, run, "a bigint, b bigint", "node")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 10, leaf: int = 4096, levels: int = 6, margin: float = 0.2, group_docs: int = 3000, group_shingles: int = 8_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    estimate = percent / 100 - margin
    rows = save(sketch(docs, width), "near-sketch")
    copies = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    # a class is known by a number of its own: a hash of its digest
    classes = save(copies.select(F.xxhash64("digest").alias("id"), "digest", "least", "n_shingles", "sig"), "near-classes")
    lean = classes.select("id", "sig")
    placed = save(leaves(lean, trees, leaf, levels), "near-leaves")
    loose = components(loose_links(placed, lean, estimate), "near-loose")
    members = save(loose.join(classes.select("id", "least", "n_shingles"), "id"), "near-members")
    sizes = members.groupBy("component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    small = (F.col("k") <= group_docs) & (F.col("s") <= group_shingles)
    sized = members.join(sizes, "component").select("id", "component", "least", small.alias("small"))
    by_component = sized.where("small").select(F.col("component").alias("node"), "id")
    by_leaf = placed.join(sized.where(~F.col("small")).select("id"), "id").select("node", "id")
    # full sets are made again, for one document of each class that has a loose link
    known_id = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    wanted = members.select("id", known_id("least").alias("key")).distinct()
    texts = docs.select(known_id("doc_id").alias("key"), "text").join(wanted.hint("merge"), "key").select("id", "text")
    # an id that stands for several texts brings them all; only the class's own stays
    sets = full_sets(texts, width).where(F.xxhash64("digest") == F.col("id")).drop("digest").dropDuplicates(["id"])
    groups = by_component.unionByName(by_leaf).join(sets, "id").select("node", "id", "sig", "shingles")
    linked = components(confirmed_links(groups, percent, estimate), "near-links")
    named = linked.join(classes.select("id", "least"), "id")
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    label = named.join(least, "component").select("id", "first")
    known = classes.select("id", "digest", "least").join(label, "id", "left").select("digest", F.coalesce("first", "least").alias("component_id"))
    drop_saved(placed)
    out = rows.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
