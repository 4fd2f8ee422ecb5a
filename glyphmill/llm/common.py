"""Shared plumbing of the training-data operators.

* Intermediate tables go to the folder that the cluster shares
  (``spark.checkpoint.dir``), never to a machine's own disk, so that a lost
  executor costs a recomputation and not the job.
* Connected components run as DataFrame joins and aggregations; neither links
  nor labels are gathered on the driver.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_own_dir: dict[str, str] = {}


@contextmanager
def without_collection():
    """Reference counts suffice where many small objects are made and none in cycles; the collector would scan them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all is one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder, and executors can't read each other's disks")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir[app] = f"file://{folder}"
    return _own_dir[app]


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While it holds, shuffle files of an action go when the action is over, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A shared folder that is a local path is written without checksum files: for each file Hadoop else starts ``chmod`` four times instead of once,
#: and as long as an executor starts a process, its memory is that of two.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/glyphmill/{tag}-{uuid.uuid4().hex}"
    with shuffle_cleanup(df.sparkSession):
        df.write.options(**PLAIN_FILES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Remove a table made by :func:`save` that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if not isinstance(column, pa.Array):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def nullable(schema: StructType) -> StructType:
    """The schema with all fields nullable, as rows from Python may be."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that further columns clash with none of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores added, as no column of ``docs`` is called."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_memory() -> None:
    """Hand memory that is free back to the system: workers live on, and share an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that Python objects of few rows live at once; free memory goes back when they end."""
    for batch in batches:
        for start in range(0, batch.num_rows, max_rows):
            yield batch.slice(start, max_rows)
    release_memory()


def key_groups(batches: Iterator[pa.RecordBatch], key: str, chunk: int = 4096, singles: bool = False) -> Iterator[pa.Table]:
    """Groups of rows with one key, from batches that are sorted by it.

    Only the rows of one group and one batch are held. The caller bounds groups. Groups of one row may be left out unless ``singles``.
    """
    held: list[pa.Table] = []
    for batch in slices(batches, chunk):
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held and held[-1][key][0] != rows[key][0]:
            yield pa.concat_tables(held)
            held = []
        keys = rows[key].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(starts[:-1], starts[1:]):
            if held:
                held.append(rows.slice(a, b - a))
                yield pa.concat_tables(held)
                held = []
            elif singles or b - a > 1:
                yield rows.slice(a, b - a)
        held.append(rows.slice(starts[-1]))
    if held:
        yield pa.concat_tables(held)


def local_edges(ids: np.ndarray, rows: int, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links (member, smallest id of its cluster) of one small node.

    ``near(i)`` gives a boolean mask over rows ``i+1 ..``. At most rows-1 links are emitted.
    """
    label = np.arange(rows)
    for i in range(rows - 1):
        hit = np.flatnonzero(near(i)) + i + 1
        if hit.size:
            found = np.unique(np.r_[label[i], label[hit]])
            if found.size > 1:
                label[np.isin(label, found[1:])] = found[0]
    return spanning(ids, label)


def spanning(ids: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links from each member to the smallest id with its label."""
    order = np.lexsort((ids, label))
    lab, sid = label[order], ids[order]
    head = np.r_[True, lab[1:] != lab[:-1]]
    least = sid[np.flatnonzero(head)][np.cumsum(head) - 1]
    return [(int(a), int(b)) for a, b in zip(sid, least) if a != b]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct links (u > v): large joins bigger neighbours to the least one, small the others."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each id has one link up, to an id that has none: then that is its component."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    between = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return not several.unionByName(between).take(1)


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long) -> (id, component), the component being its smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the
    number of links never grows and a round halves the distance to the root in
    practice. Every round is written to the shared folder. Ids without a link to another id
    are not in the result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = save(pairs, f"{tag}-edges")
    for _ in range(max_rounds):
        if _is_stars(now):
            break
        new = save(_star(_star(now, True), False), f"{tag}-edges")
        drop_saved(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)


def group_ids(df: DataFrame, parts: Callable, schema: str, key: str) -> DataFrame:
    """Run ``parts`` (Arrow batches -> Arrow batches) over rows dealt and sorted by ``key``."""
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(parts, schema)
