"""Lexicons: scans of words with frequency, validation, filtering and assembly into codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lexicon_of_parts(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(word, chars, freq, ord): part names as words of tokens; frequency is the quantity ordered.

    Quantities are summed by part before the join, so the join has a row a part.
    """
    ordered = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return (
        part.select("p_partkey", "p_name").join(ordered, "p_partkey", "left").groupBy(F.col("p_name").alias("word"))
        .agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("freq"), F.min("p_partkey").alias("ord"))
        .select("word", F.split("word", " ").alias("chars"), "freq", "ord")
    )


def lexicon_of_tokens(documents: DataFrame, lang: str = "en") -> DataFrame:
    """(word, freq): words of Latin letters in the texts of a language, with their counts."""
    words = documents.where(F.col("lang") == lang).select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def validate(lexicon: DataFrame, repertoire: DataFrame, key: str = "word") -> DataFrame:
    """Entries of which every character is known; ``repertoire`` has a column ``char``.

    Unknown characters are few and entries many: bad entries are found by an anti-join of distinct characters.
    """
    chars = lexicon.select(key, F.explode(F.split(key, "")).alias("char"))
    unknown = chars.select("char").distinct().join(repertoire.select("char"), "char", "left_anti")
    bad = chars.join(unknown, "char").select(key).distinct()
    return lexicon.join(bad, key, "left_anti")


def filter_lexicon(lexicon: DataFrame, repertoire: DataFrame, allowed: Column, key: str = "word") -> DataFrame:
    """Entries whose known characters all satisfy ``allowed``; unknown characters don't count against them."""
    refused = repertoire.where(~F.coalesce(allowed, F.lit(True))).select("char")
    bad = lexicon.select(key, F.explode(F.split(key, "")).alias("char")).join(refused, "char").select(key).distinct()
    return lexicon.join(bad, key, "left_anti")


def characters_used(lexicon: DataFrame, repertoire: DataFrame, key: str = "word") -> DataFrame:
    """Known characters that occur in the lexicon."""
    used = lexicon.select(F.explode(F.split(key, "")).alias("char")).distinct()
    return repertoire.join(used, "char", "left_semi")


def dedup_assembly(rows: DataFrame, dedupe_variants: bool = False) -> DataFrame:
    """Rows (ord, word, pinyin, seq, freq) grouped by word and sequence.

    Frequencies add up, pronunciations are listed in input order, the first order
    number stays. An entry that several glyphs give one sequence counts once a glyph, unless ``dedupe_variants``.
    """
    if dedupe_variants:
        rows = rows.dropDuplicates(["ord", "word", "seq"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pinyin"))), lambda x: x["pinyin"])
    return rows.groupBy("word", "seq").agg(F.sum("freq").alias("freq"), listed.alias("pinyin"), F.min("ord").alias("ord"))


def dedup_dynamic(rows: DataFrame) -> DataFrame:
    """Rows (ord, word, seq, conds, payload): the first of each word and sequence, whatever its conditions."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("word", "seq")]), "ord").alias("first")
    return rows.groupBy("word", "seq").agg(first).select("word", "seq", "first.*")
