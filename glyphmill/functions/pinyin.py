"""Rewriting of syllables by ordered rules.

A rule is (kind, from, to): ``xform`` replaces the first match of a pattern,
``xlit`` the first character of a class by the one at its place, or nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in rule sets.
RULES: dict[str, list[tuple[str, str, str]]] = {
    "initial": [("xform", "^([bpmfdtnlgkhjqxzcsr]h?|^).+$", "$1"), ("xform", "^$", "0")],
    "final": [("xform", "^([jqxy])u", "$1v"), ("xform", "yv", "v"), ("xform", "yi?", "i"), ("xform", "wu?", "u"), ("xform", "iu", "iou"), ("xform", "u([in])", "ue$1"), ("xform", r"^.*?([aeêiouv].*|m|ng?)\d$", "$1")],
    "double_initial": [("xform", "^([bpmfdtnlgkhjqxzcsryw]h?|^).+$", "$1"), ("xform", "^$", "0")],
    "double_final": [("xform", r"^.*?([aeêiouv].*|m|ng?)\d$", "$1")],
    "tone": [("xform", r".+(\d)", "$1")],
    "first": [("xform", "^(.).+", "$1")],
    "last": [("xform", r".*(.)\d", "$1")],
}


def rewrite(rules: list[tuple[str, str, str]], syllable: Column) -> Column:
    """One expression: each rule replaces its first match only, by matching what stands before it lazily and keeping it."""

    def apply(s: Column, rule: tuple[str, str, str]) -> Column:
        kind, old, new = rule
        if kind == "xlit":
            place = F.regexp_extract(s, f"^(?s:[^{old}]*)([{old}])", 1)
            found = F.when(place == "", s)
            for k, c in enumerate(old):
                found = found.when(place == c, F.regexp_replace(s, f"^((?s:[^{old}]*))[{old}]", "$1" + (new[k].replace("$", r"\$") if k < len(new) else "")))
            return found.otherwise(s)
        if old.startswith("^"):
            return F.regexp_replace(s, old, new)
        shifted = "".join(f"${int(new[i + 1]) + 1}" if c == "$" and i + 1 < len(new) and new[i + 1].isdigit() else ("" if i and new[i - 1] == "$" and c.isdigit() else c) for i, c in enumerate(new))
        return F.regexp_replace(s, f"^((?s:.*?))(?:{old})", "$1" + shifted)

    return reduce(apply, rules, syllable)


def analyse(syllables: DataFrame, rule_sets: dict[str, list] | None = None) -> DataFrame:
    """(syllable, one column a rule set), for each distinct syllable: words are many, syllables few."""
    sets = RULES | (rule_sets or {})
    return syllables.select("syllable").distinct().select("syllable", *[rewrite(r, F.col("syllable")).alias(n) for n, r in sets.items()])


def element_table(syllables: DataFrame, rule_sets: dict[str, list] | None = None) -> DataFrame:
    """(element): every ``rule set-value`` that occurs."""
    sets = RULES | (rule_sets or {})
    done = analyse(syllables, rule_sets)
    pairs = F.array(*[F.concat(F.lit(n + "-"), F.col(n)) for n in sets])
    return done.select(F.explode(pairs).alias("element")).distinct()


def analyse_lexicon(lexicon: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (ord, word, pinyin, freq) with the elements of each syllable, in order; a row with an unknown syllable goes."""
    names = [c for c in table.columns if c != "syllable"]
    parts = lexicon.select("ord", F.posexplode("pinyin").alias("k", "syllable")).join(table, "syllable", "left")
    per = parts.groupBy("ord").agg(F.bool_and(F.col(names[0]).isNotNull()).alias("_all"), F.array_sort(F.collect_list(F.struct("k", *names))).alias("elements"))
    return lexicon.join(per.where("_all").drop("_all"), "ord")
