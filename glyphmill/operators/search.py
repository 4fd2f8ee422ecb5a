"""Searches over characters, elements and code tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pattern(text: str | None) -> str | None:
    """A pattern, or none where it isn't one: then the condition is left out."""
    if not text:
        return None
    try:
        re.compile(text)
    except re.error:
        return None
    return text


def characters(rows: DataFrame, name: str | None = None, strokes: str | None = None, code: str | None = None, tag: str | None = None, operator: str | None = None, part: str | None = None) -> DataFrame:
    """Rows (cp, char, name, strokes, tags, operator, parts) that fit all that is asked.

    A name is part of the alias or the character; strokes are a pattern; a code point is hexadecimal or decimal; tag, structure
    and part are of one glyph.
    """
    out = rows
    if name:
        out = out.where(F.contains(F.coalesce("name", "char"), F.lit(name)))
    if pattern := _pattern(strokes):
        out = out.where(F.col("strokes").rlike(pattern))
    if code:
        values = [int(code, base) for base in (16, 10) if re.fullmatch("[0-9a-fA-F]+" if base == 16 else "[0-9]+", code)]
        out = out.where(F.col("cp").isin(values) if values else F.lit(False))
    if tag:
        out = out.where(F.array_contains(F.split("tags", ","), tag))
    if operator:
        out = out.where(F.col("operator") == operator)
    if part:
        out = out.where(F.array_contains(F.split("parts", " "), part))
    return out


def quick(rows: DataFrame, text: str, least: int = 5) -> DataFrame:
    """Rows by the start of their strokes, the character itself or part of the alias; as many as have just these strokes, five at least."""
    exact = rows.where(F.col("strokes") == text).count()
    fits = F.col("strokes").startswith(text) | (F.col("char") == text) | F.contains(F.coalesce("name", F.lit("")), F.lit(text))
    return rows.where(fits).orderBy(F.col("strokes") != text, F.length("strokes"), "cp").limit(max(least, exact))


def element_pool(rows: DataFrame, text: str, page: int = 0, size: int = 100) -> DataFrame:
    """A page of elements by stroke pattern or name, without radical blocks and single strokes."""
    pattern = _pattern(text)
    fits = F.contains(F.coalesce("name", "char"), F.lit(text)) | (F.col("strokes").rlike(pattern) if pattern else F.lit(False))
    return rows.where(~F.col("block").isin("kangxi", "radicals-sup") & (F.length("strokes") > 1) & fits).orderBy("cp").offset(page * size).limit(size)


def element_picker(rows: DataFrame, text: str) -> DataFrame:
    """Elements by name or start of strokes, short ones first."""
    return rows.where(F.contains("name", F.lit(text)) | F.col("strokes").startswith(text)).orderBy(F.length("strokes"), "name")


def code_rows(rows: DataFrame, word: str | None = None, full: str | None = None, short: str | None = None, positions: dict[int, str] | None = None, short_length: int | None = None) -> DataFrame:
    """Rows of a code table by patterns on its columns, elements at positions of the sequence, and the length of the short code."""
    for column, text in (("word", word), ("full", full), ("short", short)):
        if pattern := _pattern(text):
            rows = rows.where(F.col(column).rlike(pattern))
    for k, element in (positions or {}).items():
        rows = rows.where(F.get("seq", F.lit(k)) == element)
    return rows if short_length is None else rows.where(F.length("short") == short_length)


def analysis_rows(rows: DataFrame, necessary: DataFrame, customised: DataFrame | None = None, skip_single: bool = False) -> DataFrame:
    """Analyses (name, roots) but those of necessary roots; only customised ones; without single strokes."""
    out = rows.join(necessary.select("name"), "name", "left_anti")
    if customised is not None:
        out = out.join(customised.select("name"), "name", "left_semi")
    return out.where(~((F.size("roots") == 1) & F.element_at("roots", 1).rlike("^[1-7]$"))) if skip_single else out


def objective_rows(rows: DataFrame, objective: str) -> DataFrame:
    """(word, code) of an objective: characters or words, by full or short codes."""
    one = F.size("chars") == 1
    return rows.where(one if objective.startswith("character") else ~one).select("word", F.col("short" if objective.endswith("short") else "full").alias("code"))


def by_list(values: Column, order: list[str]) -> Column:
    """Sort key by the place in a list; others come first."""
    return F.array_position(F.array(*map(F.lit, order)), values)
