"""Statistics over code tables: collisions, ranks, distributions, proof-reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import codes as C

#: Default tiers of the most frequent characters and words; none means all.
CHARACTER_TIERS = (300, 500, 1500, 3000, 4500, 6000, None)
WORD_TIERS = (2000, 5000, 10000, 20000, 40000, 60000, None)


def collisions(codes: DataFrame, key: str = "code") -> DataFrame:
    """(code, n, words): groups of more than one word with one code; words in order, joined by spaces."""
    return codes.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words")).where("n > 1")


def collision_total(codes: DataFrame, key: str = "code") -> DataFrame:
    """Words beyond the first of each code, and the largest group."""
    return codes.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("excess"), F.max("n").alias("largest"), F.count("*").alias("n_codes"))


def collision_estimate(codes: DataFrame, selected: list[int], length: int, alphabet: int) -> DataFrame:
    """Excess words if all positions are selected; else expected pairs if the others were keyed at random; rounded."""
    sizes = codes.select(C.masked_key(F.col("code"), selected, length).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    if len(selected) == length:
        return sizes.agg(F.round(F.sum(F.col("n") - 1)).cast("bigint").alias("estimate"))
    per = 2.0 * float(alphabet) ** (length - len(selected))
    return sizes.agg(F.round(F.sum(F.col("n") * F.col("n")).cast("double") / F.lit(per)).cast("bigint").alias("estimate"))


def with_rank(codes: DataFrame, by: str = "code", name: str = "rank") -> DataFrame:
    """Rank from 0 among words of one code: most frequent first, then by word."""
    return codes.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc("freq"), "word")) - 1)


def frequency_rank(codes: DataFrame, prefix: int = 2) -> DataFrame:
    """``codes`` with their place (from 1) by frequency, then word.

    Words are numbered within cells of one frequency and one beginning, and
    shifted by the sizes of the cells before; only cells, not words, meet in one window.
    """
    head = F.substring("word", 1, prefix)
    celled = codes.withColumn("_head", head)
    cells = celled.groupBy("freq", "_head").agg(F.count("*").alias("_c"))
    before = cells.select("freq", "_head", (F.sum("_c").over(Window.orderBy(F.desc("freq"), "_head")) - F.col("_c")).alias("_b"))
    numbered = celled.withColumn("_n", F.row_number().over(Window.partitionBy("freq", "_head").orderBy("word")))
    return numbered.join(before, ["freq", "_head"]).withColumn("place", F.col("_n") + F.col("_b")).drop("_head", "_n", "_b")


def top_by_frequency(rows: DataFrame, n: int) -> DataFrame:
    """The most frequent rows; a top-k, so no full sort."""
    return rows.orderBy(F.desc("freq"), "word").limit(n)


def tier_metrics(codes: DataFrame, tiers) -> DataFrame:
    """Per tier of the most frequent words: words, words that aren't first of their code, and their share of frequency."""
    placed = frequency_rank(with_rank(codes))
    tier = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(t if t is not None else (1 << 62)).alias("top")) for k, t in enumerate(tiers)]))
    rows = placed.withColumn("t", tier).where(F.col("place") <= F.col("t.top"))
    total = F.sum("freq")
    again = F.col("rank") > 0
    return rows.groupBy(F.col("t.tier").alias("tier")).agg(
        F.count("*").alias("n"), F.count_if(again).alias("duplication"),
        F.round(F.coalesce(F.sum(F.when(again, F.col("freq"))), F.lit(0)).cast("double") / total, 6).alias("duplication_share"),
    )


def short_codes(codes: DataFrame, schemes: list[tuple[int, int]]) -> DataFrame:
    """(word, short): schemes of (prefix length, capacity) in turn; each prefix goes to the most frequent words that have none yet.

    One window per scheme over the words that are left; capacity isn't shared between schemes.
    """
    left, out = codes, None
    for prefix, count in schemes:
        head = F.substring("code", 1, prefix)
        fits = F.length("code") > prefix
        turn = F.row_number().over(Window.partitionBy(head, fits).orderBy(F.desc("freq"), "word"))
        tried = left.withColumn("_got", fits & (turn <= count))
        got = tried.where("_got").select("word", head.alias("short"))
        left = tried.where("NOT _got").drop("_got")
        out = got if out is None else out.unionByName(got)
    return out.unionByName(left.select("word", F.col("code").alias("short")))


def unary_distribution(rows: DataFrame, weighted: bool, alphabet: str = C.ALPHABET) -> DataFrame:
    """(key, value): how often each key is struck; the alphabet is filled with zeros, keys outside it are added.

    Weighted by frequency, values are shares of the total over all keys.
    """
    struck = rows.select(F.explode(F.split("code", "")).alias("key"), F.col("freq").cast("double").alias("w")).where("key <> ''")
    domain = rows.sparkSession.createDataFrame([(k,) for k in alphabet], "key string")
    filled = struck.groupBy("key").agg((F.sum("w") if weighted else F.count("*").cast("double")).alias("x")).join(F.broadcast(domain), "key", "full").select("key", F.coalesce("x", F.lit(0.0)).alias("x"))
    if not weighted:
        return filled.select("key", F.col("x").alias("value"))
    # an alphabet's rows: one window over all of them is small
    return filled.withColumn("total", F.sum("x").over(Window.partitionBy())).select("key", F.round(F.expr("try_divide(x, total)"), 6).alias("value"))


def pair_counts(rows: DataFrame, first: int, second: int) -> DataFrame:
    """(pair, n): keys at two positions; words without one of them are skipped."""
    code = F.col("code")
    both = rows.where(F.length(code) > max(first, second)).select(F.concat(F.substring(code, first + 1, 1), F.substring(code, second + 1, 1)).alias("pair"))
    return both.groupBy("pair").agg(F.count("*").alias("n"))


def binary_distribution(rows: DataFrame, first: int, second: int, alphabet: str = C.ALPHABET) -> DataFrame:
    """Pair counts over the whole square of the alphabet, which is of a configuration's size."""
    square = rows.sparkSession.createDataFrame([(a + b,) for a in alphabet for b in alphabet], "pair string")
    return pair_counts(rows, first, second).join(F.broadcast(square), "pair", "full").select("pair", F.coalesce("n", F.lit(0)).alias("n"))


def bigram_counts(rows: DataFrame) -> DataFrame:
    """(bigram, n, weight): neighbouring keys of all codes."""
    grams = rows.where(F.length("code") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda i: F.substring(F.col("code"), i, F.lit(2)))).alias("bigram"), "freq")
    return grams.groupBy("bigram").agg(F.count("*").alias("n"), F.sum("freq").alias("weight"))


def row_subtotals(distribution: DataFrame) -> DataFrame:
    """(row, key, total): keys, keyboard rows and the whole, by one rollup. Keys of no row are in row 0."""
    place = F.lit(0)
    for k, keys in enumerate(C.KEYBOARD_ROWS, 1):
        place = F.when(F.instr(F.lit(keys), F.col("key")) > 0, k).otherwise(place)
    rows = distribution.select(place.alias("row"), "key", "value")
    return rows.rollup("row", "key").agg(F.sum("value").alias("total")).select(F.coalesce("row", F.lit(-1)).alias("row"), F.coalesce("key", F.lit("*")).alias("key"), "total")


def element_positions(rows: DataFrame, length: int) -> DataFrame:
    """Per element: distinct words that have it at each position, and their sum; one pivoted aggregation."""
    cells = rows.select("word", F.posexplode(F.split("code", "")).alias("position", "element")).where(F.col("element") != "")
    counts = cells.groupBy("element").pivot("position", list(range(length))).agg(F.countDistinct("word"))
    named = [F.coalesce(F.col(str(k)), F.lit(0)).alias(f"p{k}") for k in range(length)]
    out = counts.select("element", *named)
    return out.withColumn("total", sum((F.col(f"p{k}") for k in range(length)), F.lit(0)))


def collision_attribution(rows: DataFrame, length: int) -> DataFrame:
    """For words of one code: pairs of elements at positions where their sequences differ, with their counts.

    ``rows`` has word, code and seq (a string of elements). Pairs within a code are counted from the
    counts of distinct sequences, position by position, so that a large group isn't squared row by row.
    """
    cells = rows.select("code", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("position"), "seq").where(F.length("seq") >= F.col("position"))
    counts = cells.groupBy("code", "position", F.expr("substring(seq, position, 1)").alias("e")).agg(F.count("*").alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, (F.col("a.code") == F.col("b.code")) & (F.col("a.position") == F.col("b.position")) & (F.col("a.e") < F.col("b.e")))
    return pairs.groupBy(F.col("a.e").alias("first"), F.col("b.e").alias("second")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("n"))


def proofread(words: DataFrame, external: DataFrame) -> DataFrame:
    """(word, code, verdict): against an external table with any number of codes a word: correct, incorrect or unknown."""
    listed = external.groupBy("word").agg(F.collect_set("code").alias("known"))
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.array_contains("known", F.col("code")), "correct").otherwise("incorrect")
    return words.join(listed, "word", "left").select("word", "code", verdict.alias("verdict"))


def proofread_summary(checked: DataFrame) -> DataFrame:
    """Counts, and the rounded percentage of correct among known; null where none is known."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return checked.agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("unknown").alias("unknown"), F.round(F.expr("try_divide(100.0D * count_if(verdict = 'correct'), count_if(verdict <> 'unknown'))")).cast("bigint").alias("accuracy"))
