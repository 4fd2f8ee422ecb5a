"""Reference graphs: levels, leaves, components, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans.checkpoint import cut


class CycleError(ValueError):
    """References form a cycle; the message names up to 100 members."""


def topological_levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, level): level 0 refers to nothing, others stand one above the highest of what they refer to.

    ``edges`` has node and ref. Each round drops the edges to nodes of the last level; a node
    without edges left is on the next. Rounds are as many as levels; only a small count comes to the driver.
    """
    rest = cut(edges.join(nodes.select(F.col("node").alias("ref")), "ref", "left_semi").select("node", "ref").distinct())
    left, out = cut(nodes.select("node").distinct()), None
    for level in range(max_depth):
        blocked = rest.select("node").distinct()
        here = cut(left.join(blocked, "node", "left_anti").select("node", F.lit(level).alias("level")))
        if not here.take(1):
            if left.take(1):
                raise CycleError(", ".join(str(r["node"]) for r in left.orderBy("node").limit(100).collect()))
            break
        out = here if out is None else out.unionByName(here)
        left = cut(left.join(blocked, "node", "left_semi"))
        rest = cut(rest.join(here.select(F.col("node").alias("ref")), "ref", "left_anti").select("node", "ref"))
    return out if out is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)


def leaves(spark: SparkSession, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, leaf): what a node is made of in the end, over recursive SQL."""
    roots.createOrReplaceTempView("glyphmill_roots")
    edges.createOrReplaceTempView("glyphmill_edges")
    return spark.sql("""
        WITH RECURSIVE walk (root, node, depth) AS (
          SELECT node, node, 0 FROM glyphmill_roots
          UNION ALL SELECT w.root, e.ref, w.depth + 1 FROM walk w JOIN glyphmill_edges e ON e.node = w.node WHERE w.depth < 99
        ) SELECT DISTINCT root, node AS leaf FROM walk WHERE node NOT IN (SELECT node FROM glyphmill_edges)""")


def partition(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, class): connected classes named by their least node, by rounds of least labels with jumps."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("node", F.col("node").alias("class"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("low"))
        lower = label.join(near, "node", "left").select("node", F.least("class", F.coalesce("low", "class")).alias("class"))
        jump = lower.select(F.col("node").alias("class"), F.col("class").alias("up"))
        new = lower.join(jump, "class", "left").select("node", F.least("class", F.coalesce("up", "class")).alias("class"))
        new = cut(new)
        changed = new.join(label.select("node", F.col("class").alias("old")), "node").where("class <> old").take(1)
        label = new
        if not changed:
            return label
    raise RuntimeError("classes did not settle")


def rename(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows whose references change: (node, k, ref) with old names replaced by new; ``renames`` has old, new."""
    changed = edges.join(renames, edges["ref"] == renames["old"], "left").select("node", "k", F.coalesce("new", "ref").alias("ref"), F.col("new").isNotNull().alias("_c"))
    touched = changed.where("_c").select("node").distinct()
    return changed.join(touched, "node", "left_semi").select("node", "k", "ref")
