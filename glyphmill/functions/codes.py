"""Scalar functions over codes, sequences and code positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_POSITION = "ε"
MASKED = "*"
#: The default keyboard rows.
KEYBOARD_ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def formula_index(letter: str) -> int:
    """a..m count from the start, n..z from the end: a is 0, z is -1."""
    k = ord(letter.lower()) - 97
    if not 0 <= k < 26:
        raise ValueError(f"not a formula letter: {letter!r}")
    return k if k < 13 else k - 26


def signed_element(seq: Column, index: int) -> Column:
    """1-based; negative from the end; 0 and positions outside are null."""
    return F.lit(None) if index == 0 else F.try_element_at(seq, F.lit(index))


def at(seq: Column, index: int) -> Column:
    """0-based; negative from the end; positions outside are null."""
    return F.try_element_at(seq, F.lit(index + 1 if index >= 0 else index))


def compose(formula: str, parts: Column) -> Column:
    """Code of a word: letter pairs name a part and a position in it; pairs outside are skipped.

    ``parts`` is an array of strings, a code for each character.
    """
    pairs = [(formula_index(a), formula_index(b)) for a, b in zip(formula[::2], formula[1::2])]
    picked = []
    for part, position in pairs:
        code = at(parts, part)
        picked.append(F.coalesce(F.when(F.length(code) >= (position + 1 if position >= 0 else -position), F.substring(code, position + 1 if position >= 0 else position, 1)), F.lit("")))
    return F.concat(*picked)


def compose_by_rules(rules: list[dict], parts: Column) -> Column:
    """The first rule whose length fits (``length_equal`` or inclusive ``length_in_range``) composes; no rule is null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        n = F.size(parts)
        fits = n == rule["length_equal"] if "length_equal" in rule else n.between(*rule["length_in_range"])
        out = F.when(fits, compose(rule["formula"], parts)).otherwise(out)
    return out


def masked_key(code: Column, selected: list[int], length: int) -> Column:
    """Positions of a code, masked where not selected and marked where missing, joined by spaces."""
    cells = []
    for k in range(length):
        cells.append(F.when(F.length(code) > k, F.substring(code, k + 1, 1)).otherwise(EMPTY_POSITION) if k in selected else F.lit(MASKED))
    return F.concat_ws(" ", *cells)


def position_text(key: Column, element: Column, index: Column) -> Column:
    """``element.index`` for a reference, the literal key, or ``ε`` for neither."""
    return F.coalesce(F.when(element.isNotNull(), F.concat_ws(".", element, index.cast("string"))), key, F.lit(EMPTY_POSITION))


def identifier(word: Column, pinyin_lists: Column) -> Column:
    """word - lists of syllables: lists by commas, syllables by spaces."""
    return F.concat(word, F.lit("-"), F.array_join(F.transform(pinyin_lists, lambda p: F.array_join(p, " ")), ","))


def code_point_name(cp: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    return F.concat(F.lit("U+"), F.when(cp < 0x1000, F.lpad(F.hex(cp), 4, "0")).otherwise(F.hex(cp)))


def mask_of(indices: list[int], n: int) -> int:
    """Bit mask of stroke indices; the first stroke is the highest bit."""
    return sum(1 << (n - 1 - i) for i in indices)


def indices_of(mask: int, n: int) -> list[int]:
    return [i for i in range(n) if mask >> (n - 1 - i) & 1]


def mask_column(indices: Column, n: Column) -> Column:
    return F.aggregate(indices, F.lit(0).cast("bigint"), lambda m, i: m + F.call_function("shiftleft", F.lit(1).cast("bigint"), (n - 1 - i).cast("int")))
