"""Typing times: robust means, normalisation by a baseline, pooling, key pair classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.plans.checkpoint import cut


# Coefficients of the rational approximation of the error function (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """The error function as arithmetic, within 1.5e-7."""
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def robust_mean(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, std, n, raw): mean of each group without outliers by Chauvenet's criterion, its standard error and sizes.

    A value goes where the share of normal values as far from the mean times the size is a half or less; rounds repeat until
    nothing goes in any group. Equal samples keep all. What stays of a group is an interval, so a round is two
    aggregations of the samples within it, and its ends are all that is written: groups of any size are spread over tasks.
    """
    rows = samples.select(*key, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    kept = cut(rows.groupBy(*key).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("raw")))
    inside = F.col("x").between(F.col("low"), F.col("high"))
    while True:
        stats = rows.join(kept, key).where(inside).groupBy(*key).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("*").alias("n"))
        stats = cut(kept.join(stats, key))
        near = erf(F.abs(F.col("x") - F.col("m")) / F.col("s") / math.sqrt(2)) < 1 - 1 / (2 * F.col("n").cast("double"))
        left = rows.join(stats, key).where(inside & (F.col("s").isNull() | (F.col("s") == 0) | near))
        ends = cut(left.groupBy(*key).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max("raw").alias("raw"), F.count("*").alias("stay"), F.max("n").alias("n")))
        if not ends.where("stay < n").take(1):
            break
        kept = ends.select(*key, "low", "high", "raw")
    std = F.when(F.col("n") == 1, 0.0).otherwise(F.col("s") / F.sqrt(F.col("n").cast("double")))
    return stats.select(*key, F.col("m").alias("value"), std.alias("std"), "n", "raw")


def normalise(means: DataFrame, user: str, distance: str, cls: str) -> DataFrame:
    """Means over the user's baseline (the least class of distance 0), corrected for its error, with relative errors added in squares."""
    base = means.where(F.col(distance) == 0).groupBy(user).agg(F.min_by(F.struct("value", "std"), cls).alias("b"))
    r = means.join(base, user)
    ratio = F.col("value") / F.col("b.value")
    correction = 1 + F.col("b.std") * F.col("b.std") / (F.col("b.value") * F.col("b.value"))
    spread = F.sqrt(F.pow(F.col("std") / F.col("value"), 2) + F.pow(F.col("b.std") / F.col("b.value"), 2)) * ratio
    own = F.col(distance) == 0
    return r.select(user, cls, distance, F.when(own, 1.0).otherwise(ratio * correction).alias("ratio"), F.when(own, 0.0).otherwise(spread).alias("ratio_std"))


def pool(ratios: DataFrame, cls: str, distance: str) -> DataFrame:
    """Mean over users with equal weight, and its error."""
    return ratios.groupBy(cls).agg(F.min(distance).alias(distance), F.avg("ratio").alias("value"), (F.sqrt(F.sum(F.col("ratio_std") * F.col("ratio_std"))) / F.count("*")).alias("std"))


def label(pooled: DataFrame, distance: str, order: str) -> DataFrame:
    """Distance and a letter by rank of value within it; different hands are ``/``."""
    k = F.row_number().over(Window.partitionBy(distance).orderBy("value", order)) - 1
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k + 1), F.lit(1))
    return pooled.withColumn("label", F.when(F.col(distance) == -1, "/").otherwise(F.concat(F.col(distance).cast("int").cast("string"), letter)))


def user_ranking(samples: DataFrame, user: str, value: str) -> DataFrame:
    """(user, n, mean): samples and rounded mean time.

    Times are summed as decimals of ten places, so that a mean of exactly a half is rounded alike in whatever order rows
    come; users with a time that isn't such a decimal have the mean of doubles.
    """
    exact = F.col("t").try_cast("decimal(24, 10)")
    other = F.max(F.col("t").isNotNull() & ~exact.cast("double").eqNullSafe(F.col("t").cast("double")))
    sums = samples.select(user, F.col(value).alias("t")).groupBy(user).agg(F.count("*").alias("n"), F.count("t").alias("known"), F.sum(exact).alias("s"), other.alias("other"), F.avg("t").alias("plain"))
    away = F.expr("(abs(s + s) + known) DIV nullif(2 * known, 0)")
    mean = F.when(F.col("other"), F.round("plain").cast("bigint")).otherwise(F.when(F.col("s") < 0, -away).otherwise(away))
    return sums.select(user, "n", mean.alias("mean"))


def key_pairs(spark) -> DataFrame:
    """The 1,225 pairs of a grid of 5 rows and 7 columns, with geometry: distance (-1 for different hands) and displacement."""
    i, f = F.col("initial"), F.col("final")
    pairs = spark.range(35).select(F.col("id").cast("int").alias("initial"), F.explode(F.sequence(F.lit(0), F.lit(34))).alias("final"))
    hands = (i != f) & (((i < 20) & (f >= 15)) | ((i >= 15) & (f < 20)))
    col, row = lambda n: F.floor(n / 5).cast("int"), lambda n: n % 5
    dx, dy = col(f) - col(i), row(f) - row(i)
    one_hand = ((i < 15) & (f < 15)) | ((i >= 20) & (f >= 20))
    side = F.when((i < 15) & (f < 15), 0).when((i >= 20) & (f >= 20), 1)
    reflect = lambda n: (6 - col(n)) * 5 + row(n)
    return pairs.select(
        (i * 35 + f).alias("node"), "initial", "final", F.when(hands, -1).otherwise(dx * dx + dy * dy).alias("distance"), dx.alias("dx"), dy.alias("dy"), one_hand.alias("one_hand"), side.alias("side"),
        (f * 35 + i).alias("reverse"), (reflect(i) * 35 + reflect(f)).alias("mirror"),
    )


def key_pair_links(pairs: DataFrame) -> DataFrame:
    """(a, b): pairs of equal effort: different hands, one key, reversed, mirrored, or moved on one hand. Classes of a key link to their least member only."""
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min("node").alias("b")).join(rows, list(by)).select(F.col("node").alias("a"), "b")
    moved = least(pairs.where("one_hand"), "dx", "dy")
    hands = least(pairs.where("distance = -1"), "distance")
    same = least(pairs.where("initial = final"), "dx", "dy")
    links = pairs.select(F.col("node").alias("a"), F.col("reverse").alias("b")).unionByName(pairs.select(F.col("node").alias("a"), F.col("mirror").alias("b")))
    return links.unionByName(moved).unionByName(hands).unionByName(same).where("a <> b").distinct()
