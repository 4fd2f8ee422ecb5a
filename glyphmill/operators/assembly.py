"""Assembly: words of analysed characters into sequences of key positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.codes import formula_index
from glyphmill.operators.lexicon import dedup_assembly
from glyphmill.operators.priority import Guarded, join


class NoRule(ValueError):
    """No rule composes words of a length."""


def default_assembler(path: Column) -> Column:
    """One character: what its code path gives."""
    return path


def head_rest_assembler(sounds: Column, head: Column, rest: Column, every: Column, most_head: int = 2, most: int = 4) -> Column:
    """Two sound keys, then shape keys: at most two of the head and four in all; without a head, of the whole."""
    joined = F.slice(F.concat(F.slice(head, 1, most_head), rest), 1, most)
    return F.concat(F.slice(sounds, 1, 2), F.when(F.size(head) > 0, joined).otherwise(F.slice(every, 1, most)))


def combinations(rows: DataFrame, analyses: DataFrame) -> DataFrame:
    """Rows (ord, word, chars, ...) with each combination of one sequence a character: (ord, combo, seqs).

    ``analyses`` has char, alt and seq. A word with an unanalysed character has none. Lists of
    alternatives are gathered per word and multiplied in the row, in order, without a join per position.
    """
    parts = rows.select("ord", F.posexplode("chars").alias("k", "char")).join(analyses, "char", "left")
    per = parts.groupBy("ord", "k").agg(F.array_sort(F.collect_list(F.struct("alt", "seq"))).alias("alts"), F.bool_and(F.col("seq").isNotNull()).alias("known"))
    whole = per.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("k", "alts"))).alias("lists"), F.bool_and("known").alias("known")).where("known")
    start = F.array(F.array().cast("array<array<string>>"))
    grown = F.aggregate("lists", start, lambda acc, x: F.flatten(F.transform(acc, lambda done: F.transform(x["alts"], lambda a: F.concat(done, F.array(a["seq"]))))))
    return rows.join(whole.select("ord", F.posexplode(grown).alias("combo", "seqs")), "ord")


def compose_positions(rules: list[dict], seqs: Column) -> Column:
    """Positions of a word by the first rule of its length; pairs outside are passed over; no rule is null."""
    out = F.lit(None).cast("array<string>")
    n = F.size(seqs)
    for rule in reversed(rules):
        f = rule["formula"]
        picked = []
        for a, b in zip(f[::2], f[1::2]):
            i, j = formula_index(a), formula_index(b)
            part = F.try_element_at(seqs, F.lit(i + 1 if i >= 0 else i))
            picked.append(F.try_element_at(part, F.lit(j + 1 if j >= 0 else j)))
        fits = n == rule["length_equal"] if "length_equal" in rule else n.between(*rule["length_in_range"])
        out = F.when(fits, F.array_compact(F.array(*picked))).otherwise(out)
    return out


def assemble(lexicon: DataFrame, analyses: DataFrame, rules: list[dict], dedupe_variants: bool = False, strict: bool = True) -> DataFrame:
    """(word, seq, freq, pinyin, ord): every entry by every combination of its characters' analyses, grouped by word and sequence.

    One character is its own sequence. Without a rule for a length the assembly fails, or the sequence is empty if not ``strict``.
    """
    every = combinations(lexicon, analyses)
    one = F.size("seqs") == 1
    made = every.withColumn("_seq", F.when(one, F.element_at("seqs", 1)).otherwise(compose_positions(rules, F.col("seqs"))))
    if strict:
        lacking = made.where("_seq IS NULL").select(F.size("chars").alias("n")).take(1)
        if lacking:
            raise NoRule(f"words of {lacking[0]['n']} characters")
    rows = made.select("ord", "word", "pinyin", F.array_join(F.coalesce("_seq", F.array().cast("array<string>")), " ").alias("seq"), "freq")
    return dedup_assembly(rows, dedupe_variants)


def assemble_dynamic(lexicon: DataFrame, lists: DataFrame, rules: list[dict]) -> DataFrame:
    """(word, seq, conditions, ord, place): sequences under conditions, of characters whose analyses are priority lists.

    ``lists`` has char, place, conditions (array) and seq (array). A word's lists are gathered in its row and joined there in
    priority order; a word without a rule has an empty sequence. Of equal sequences of a word the first stays.
    """
    from glyphmill.operators.lexicon import dedup_dynamic

    parts = lexicon.select("ord", F.posexplode("chars").alias("k", "char")).join(lists, "char", "left")
    per = parts.groupBy("ord", "k").agg(F.array_sort(F.collect_list(F.struct("place", "conditions", "seq"))).alias("rows"), F.bool_and(F.col("place").isNotNull()).alias("known"))
    whole = per.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rows"))), lambda x: x["rows"]).alias("lists"), F.bool_and("known").alias("known")).where("known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ord_, word, given in zip(*(batch.column(k).to_pylist() for k in range(3))):
                guarded = [[Guarded(tuple(r["conditions"]), list(r["seq"])) for r in rows] for rows in given]
                for place, g in enumerate(join(guarded, lambda seqs: seqs)):
                    out.append({"ord": ord_, "word": word, "seq": " ".join(compose_list(rules, g.value)), "conditions": " ".join(g.conditions), "place": place})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("ord", pa.int64()), ("word", pa.string()), ("seq", pa.string()), ("conditions", pa.string()), ("place", pa.int32())]))

    made = lexicon.join(whole, "ord").select(F.col("ord").cast("bigint").alias("ord"), "word", "lists").mapInArrow(run, "ord bigint, word string, seq string, conditions string, place int")
    ordered = made.withColumn("_o", F.struct("ord", "place"))
    return dedup_dynamic(ordered.select("word", "seq", F.col("_o").alias("ord"), "conditions")).select("word", "seq", "conditions", F.col("ord.ord").alias("ord"), F.col("ord.place").alias("place"))


def compose_list(rules: list[dict], seqs: list[list[str]]) -> list[str]:
    """The same composition as ``compose_positions``, over lists; a single character is its sequence, no rule is empty."""
    if len(seqs) == 1:
        return seqs[0]
    rule = next((r for r in rules if ("length_equal" in r and r["length_equal"] == len(seqs)) or ("length_in_range" in r and r["length_in_range"][0] <= len(seqs) <= r["length_in_range"][1])), None)
    out = []
    for a, b in zip(rule["formula"][::2], rule["formula"][1::2]) if rule else ():
        i, j = formula_index(a), formula_index(b)
        if -len(seqs) <= i < len(seqs) and -len(seqs[i]) <= j < len(seqs[i]):
            out.append(seqs[i][j])
    return out
