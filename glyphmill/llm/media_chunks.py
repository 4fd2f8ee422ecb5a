"""Operator 9: payloads as content-defined chunks, deduplicated and read back.

A payload (the UTF-8 text, filled up with spaces to a positive multiple of
192 bytes) is cut where a rolling gear hash has given bits clear, so that equal
passages give equal chunks wherever they stand. A chunk is known by its digest;
the chunk store keeps each once, compressed with a dictionary that is fitted on a bounded
sample (``DICTIONARY_ROWS`` clipped texts) and is part of the store. A document is a recipe: the ordered list of digests and lengths.
Reading back joins recipes to the store, and payloads of several chunks are
put together in order; every chunk is verified against its digest and the whole against its length.

The stored form of a document is its recipe followed by its chunks as they lie in the store, compressed;
``media_bytes`` and ``media_sha256`` are its size and hash. The store stays: its table is named by the result's ``_table``.

Cases: null and empty texts are a payload of 192 spaces; equal texts share a recipe,
are put together once, and get equal values; repeated rows give a row each; very long texts are chunked whole; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import key_groups, save, slices, text_bytes

UNIT = 192
#: Least bytes of a chunk, clear bits of a cut (2**9 bytes more on average, some 700 in all), most bytes.
LEAST, SPREAD_BITS, MOST = 192, 9, 4096
#: A chunk in more than this share of all places is joined by broadcast: there are no more than its reciprocal of them.
HOT_SHARE = 1000
#: Parts of chunks, and of recipes, that are dealt out one after another, so that the shuffle of one is gone before the next.
PASSES = 2
DICTIONARY_ROWS, DICTIONARY_CLIP, DICTIONARY_BYTES = 2000, 6000, 112_640
GEAR = np.random.default_rng(192).integers(0, 1 << 32, 256, dtype=np.uint32)
DIGEST = 16
ENTRY = DIGEST + 4


def payload(text: bytes | None) -> bytes:
    data = text or b""
    return data + b" " * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def gear_hash(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: sum of gear values, each shifted by its distance, over 32 bytes; by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        further = h.copy()
        further[k:] += h[:-k] << np.uint32(k)
        h = further
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of chunks: the first hash with clear top bits beyond the least length, or the most length."""
    n = len(data)
    if n <= LEAST:
        return [n]
    at = np.flatnonzero(gear_hash(data) >> np.uint32(32 - SPREAD_BITS) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        k = np.searchsorted(at, start + LEAST)
        end = int(at[k]) if k < len(at) else n
        end = min(end, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def recipe(data: bytes) -> tuple[bytes, list[bytes]]:
    """Digests and lengths, and the chunks."""
    chunks, start = [], 0
    for end in cuts(data):
        chunks.append(data[start:end])
        start = end
    return b"".join(digest(c) + len(c).to_bytes(4, "little") for c in chunks), chunks


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, recipe_id, recipe), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = text_bytes(rows.column(1))
            made = [recipe(payload(t))[0] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([digest(r) for r in made], pa.binary()), pa.array(made, pa.binary())],
                names=["doc_id", "n_bytes", "recipe_id", "recipe"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, recipe_id binary, recipe binary")


def fit_dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a sample of about ``DICTIONARY_ROWS`` rows, chosen by a share of hashes; empty where there is too little text.

    The driver sees the sample alone, whatever the number of tasks; of repeated rows one.
    """
    import zstandard

    share = (1 << 30) * DICTIONARY_ROWS // max(1, docs.count())
    hashed = docs.where("length(text) > 0").select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share)
    rows = hashed.select(F.substring("text", 1, DICTIONARY_CLIP).alias("t"), "h").dropDuplicates(["h"]).collect()
    samples = [r["t"].encode() for r in sorted(rows, key=lambda r: (r["h"], r["t"]))]
    if len(samples) < 100 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def chunk_rows(docs: DataFrame, dictionary: bytes, part: int, parts: int, level: int = 9) -> DataFrame:
    """(digest, packed): the compressed chunks of all documents whose digests are of one part, without repeats within a stretch of a task."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held.value), write_checksum=False).compress
        seen: set[bytes] = set()
        for rows in slices(batches):
            if len(seen) > 200_000:
                seen.clear()
            digests, packed = [], []
            for t in text_bytes(rows.column(0)):
                listed, chunks = recipe(payload(t))
                for k, c in enumerate(chunks):
                    d = listed[k * ENTRY : k * ENTRY + DIGEST]
                    if d[0] % parts == part and d not in seen:
                        seen.add(d)
                        digests.append(d), packed.append(pack(c))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])

    return docs.select("text").mapInArrow(run, "digest binary, packed binary")


def store_chunks(docs: DataFrame, dictionary: bytes, existing: DataFrame | None = None) -> DataFrame:
    """The chunk store (digest, packed): one row for each digest, bucketed by it, so that reading back moves no chunk.

    Chunks that ``existing`` has are left out by an anti-join.
    """
    spark = docs.sparkSession
    name = f"glyphmill_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in range(PASSES):
        new = chunk_rows(docs, dictionary, part, PASSES)
        if existing is not None:
            new = new.join(existing.select("digest"), "digest", "left_anti")
        rows = new.dropDuplicates(["digest"]).write.format("parquet").mode("append" if part else "error").bucketBy(buckets, "digest")
        with_cleanup(spark, lambda rows=rows: rows.saveAsTable(name))
    out = spark.table(name)
    out._table = name
    return out




def features(made: DataFrame, store: DataFrame, dictionary: bytes) -> DataFrame:
    """Read payloads back: (recipe_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each distinct recipe."""
    held = made.sparkSession.sparkContext.broadcast(dictionary)
    entry = f"transform(sequence(0, cast(length(recipe) / {ENTRY} as int) - 1), i -> substring(recipe, i * {ENTRY} + 1, {ENTRY}))"
    distinct = made.select("recipe_id", "recipe").dropDuplicates(["recipe_id"])
    # a place carries its own entry, not the whole recipe
    parts = distinct.select("recipe_id", F.posexplode(F.expr(entry)).alias("seq", "entry")).withColumn("digest", F.expr(f"substring(entry, 1, {DIGEST})"))
    total = made.agg(F.sum(F.octet_length("recipe") / ENTRY)).first()[0] or 0
    often = save(parts.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > total / HOT_SHARE).select("digest"), "media-often")
    hot = F.broadcast(store.join(F.broadcast(often), "digest"))
    rest = parts.join(F.broadcast(often), "digest", "left_anti").join(store, "digest", "left")
    columns = ["recipe_id", "seq", "entry", "packed"]
    found = parts.join(hot, "digest").select(columns).unionByName(rest.select(columns))
    kind = "recipe_id binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def measure(groups: Iterator[tuple[bytes, bytes, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held.value)).decompress
        out: list[dict] = []
        for key, listed, packed in groups:
            out.append({"recipe_id": key, **one(listed, packed, unpack)})
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("recipe_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole():
            for g in key_groups(batches, "recipe_id", 256, singles=True):
                yield g["recipe_id"][0].as_py(), b"".join(g["entry"].to_pylist()), g["packed"].to_pylist()

        yield from measure(whole())

    return found.repartition("recipe_id").sortWithinPartitions("recipe_id", "seq").mapInArrow(several, kind)


def one(listed: bytes, packed: list[bytes], unpack) -> dict:
    """Verify the chunks of a recipe and describe the payload that they make, and its stored form."""
    chunks = [unpack(p) for p in packed]
    lengths = [int.from_bytes(listed[k + DIGEST : k + ENTRY], "little") for k in range(0, len(listed), ENTRY)]
    for k, (c, n) in enumerate(zip(chunks, lengths, strict=True)):
        if len(c) != n or digest(c) != listed[k * ENTRY : k * ENTRY + DIGEST]:
            raise ValueError("a stored chunk doesn't match its recipe")
    data = b"".join(chunks)
    samples = np.frombuffer(data, np.uint8)
    stored = listed + b"".join(packed)
    counts = np.bincount(samples >> 5, minlength=8)
    return {
        "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]),
        "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"chunks={len(chunks)};mean={samples.mean():.3f};bands=" + ",".join(map(str, counts.tolist())),
    }


def with_cleanup(spark, action):
    """Run an action; files of its shuffles may go when it is over."""
    from glyphmill.llm.common import shuffle_cleanup

    with shuffle_cleanup(spark):
        return action()


def media_features(docs: DataFrame) -> DataFrame:
    """Store all payloads and describe each document from what is read back.

    Beside the rows, the result carries the store: ``_table``, ``_recipes`` (doc_id, recipe) and ``_dictionary``.
    """
    dictionary = fit_dictionary(docs)
    made = save(recipes(docs), "media-recipes")
    store = store_chunks(docs, dictionary)
    turn = F.pmod(F.xxhash64("recipe_id"), F.lit(PASSES))
    back = reduce(DataFrame.unionByName, [save(features(made.where(turn == k), store, dictionary), "media-features") for k in range(PASSES)])
    out = made.select("doc_id", "n_bytes", "recipe_id").join(back, "recipe_id")
    out = out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out._table, out._recipes, out._dictionary = store._table, made, dictionary
    return out
