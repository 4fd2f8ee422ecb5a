"""Sources and sinks: tab-separated text, code tables, repertoires, configurations."""

from __future__ import annotations

import json
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def number(text: Column) -> Column:
    """Number of a text as the formats have it: an empty text is 0, any other text that isn't a number is null."""
    return F.when(F.trim(text) == "", 0.0).otherwise(text.try_cast("double"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): lines in file order, without empty ones at the ends of the text.

    Order is the byte order of the splits of the files, as monotonically increasing numbers.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def split_table(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """(ord, cells): ragged rows; no quoting."""
    return lines.where(F.trim("line") != "").select("ord", F.split("line", separator).alias("cells"))


def _cell(k: int) -> Column:
    return F.get("cells", F.lit(k))


def dictionary(table: DataFrame) -> DataFrame:
    """(ord, word, pinyin, freq): rows of three cells whose frequency is a number."""
    return table.where(F.size("cells") >= 3).select("ord", _cell(0).alias("word"), F.split(_cell(1), " ").alias("pinyin"), number(_cell(2)).alias("freq")).where("freq IS NOT NULL AND NOT isnan(freq)")


def last_wins(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key, the last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "ord").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def key_targets(table: DataFrame) -> DataFrame:
    """(key, ideal, below, above); rows with a cell that isn't a number go; the last of a key wins."""
    rows = table.select("ord", _cell(0).alias("key"), number(_cell(1)).alias("ideal"), number(_cell(2)).alias("below"), number(_cell(3)).alias("above"))
    return last_wins(rows.where("ideal IS NOT NULL AND below IS NOT NULL AND above IS NOT NULL"), "key").drop("ord")


def equivalence(table: DataFrame) -> DataFrame:
    """(seq, value); the last of a sequence wins."""
    return last_wins(table.select("ord", _cell(0).alias("seq"), number(_cell(1)).alias("value")).where("value IS NOT NULL"), "seq").drop("ord")


def stroke_orders(table: DataFrame) -> DataFrame:
    """(char, strokes); the last of a character wins."""
    return last_wins(table.select("ord", _cell(0).alias("char"), _cell(1).alias("strokes")), "char").drop("ord")


def custom_elements(table: DataFrame) -> DataFrame:
    """(char, elements)."""
    return last_wins(table.select("ord", _cell(0).alias("char"), F.split(_cell(1), " ").alias("elements")), "char").drop("ord")


def code_table(lines: DataFrame, separator: str = "tab", word_first: bool = True) -> DataFrame:
    """(ord, word, code) of the four layouts: tab or white space between, word or code first."""
    table = split_table(lines, "\t" if separator == "tab" else r"\s+").where(F.size("cells") >= 2)
    first, second = ("word", "code") if word_first else ("code", "word")
    return table.select("ord", _cell(0).alias(first), _cell(1).alias(second)).select("ord", "word", "code")


def merge_over(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps as one; where both have a key, the second's value holds."""
    return base.select(key, F.col(value).alias("_a")).join(over.select(key, F.col(value).alias("_b"), F.lit(True).alias("_has")), key, "full").select(key, F.when(F.col("_has"), F.col("_b")).otherwise(F.col("_a")).alias(value))


REPERTOIRE = (
    "unicode INT, tygf INT, gb2312 INT, name STRING, gf0014_id INT, gf3001_id INT, ambiguous BOOLEAN, glyphs ARRAY<STRUCT<type:STRING, tags:ARRAY<STRING>, source:STRING, operator:STRING, "
    "operandList:ARRAY<STRING>, order:ARRAY<STRUCT<index:INT,strokes:INT>>, parameters:STRUCT<gap2:DOUBLE,scale2:DOUBLE,gap3:DOUBLE,scale3:DOUBLE>, "
    "strokes:ARRAY<STRUCT<feature:STRING,start:ARRAY<DOUBLE>,index:INT,curveList:ARRAY<STRUCT<command:STRING,parameterList:ARRAY<DOUBLE>>>>>>>"
)


def repertoire(spark: SparkSession, path: str, user: DataFrame | None = None) -> DataFrame:
    """A deflated JSON array of characters; user rows follow and win by code point."""
    rows = json.loads(zlib.decompress(Path(path).read_bytes()))
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "ord bigint, line string").select("ord", F.from_json("line", REPERTOIRE).alias("r")).select("ord", "r.*")
    if user is not None:
        df = df.unionByName(user.withColumn("ord", F.lit(1 << 40) + F.monotonically_increasing_id()), allowMissingColumns=True)
    return last_wins(df, "unicode").drop("ord")


def from_wire(models: DataFrame) -> DataFrame:
    """Rows of a service (glyphs as JSON text, ambiguous as 0 or 1) as repertoire rows."""
    glyphs = REPERTOIRE.split("glyphs ", 1)[1]
    return models.withColumns({"glyphs": F.from_json("glyphs", glyphs), "ambiguous": F.col("ambiguous") == 1})


def to_wire(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"glyphs": F.to_json("glyphs"), "ambiguous": F.col("ambiguous").cast("int")})


def config(path: str) -> dict:
    """A configuration of JSON, or of YAML where a reader for it is installed."""
    text = Path(path).read_text()
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # only where it is installed

        return yaml.safe_load(text)


def import_mapping(rows: DataFrame, characters: DataFrame, alphabet: str, longest: int) -> DataFrame:
    """(name, keys, verdict) of imported rows (name, keys): ``ok`` with keys cut to ``longest``, ``unknown key`` (no such element) or ``unknown value``.

    ``characters`` has name, has_glyph, private and single; only elements with a glyph that are neither private nor single strokes count.
    """
    fit = characters.where("has_glyph AND NOT private AND NOT single").select("name", F.lit(True).alias("known"))
    inside = F.coalesce(F.forall(F.split("keys", ""), lambda c: F.instr(F.lit(alphabet), c) > 0), F.lit(False))
    verdict = F.when(F.col("known").isNull(), "unknown key").when(~inside, "unknown value").otherwise("ok")
    return rows.join(fit, "name", "left").select("name", F.when(verdict == "ok", F.left("keys", F.lit(longest))).otherwise(F.col("keys")).alias("keys"), verdict.alias("verdict"))


def write_tsv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Rows as tab-separated text; arrays are joined by spaces, nulls are empty."""
    kinds = dict(rows.dtypes)
    cells = [F.coalesce(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")) for c in columns]
    rows.select(F.concat_ws("\t", *cells)).write.text(path)


def analysis_lines(rows: DataFrame) -> DataFrame:
    """(line) of rows (name, alias, roots, alternatives): roots by spaces, alternatives by ideographic spaces; private characters by alias."""
    shown = F.coalesce("alias", "name")
    joined = F.array_join(F.transform("alternatives", lambda a: F.array_join(a, " ")), "　")
    return rows.select(F.concat_ws("\t", shown, F.when(F.size("alternatives") > 0, joined).otherwise(F.array_join("roots", " "))).alias("line"))


def with_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positions from 0 in an order; for tables of a configuration's size."""
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*by)) - 1)
