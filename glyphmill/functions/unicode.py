"""Unicode blocks and character sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.fixtures import Fixture

# Block name, first and last code point, characters expected in a full repertoire.
BLOCKS = Fixture(
    "name string, begin int, end int, expected int",
    (
        ("cjk", 0x4E00, 0x9FFF, 20992), ("cjk-a", 0x3400, 0x4DBF, 6592), ("cjk-b", 0x20000, 0x2A6DF, 42720), ("cjk-c", 0x2A700, 0x2B73F, 4160), ("cjk-d", 0x2B740, 0x2B81F, 222),
        ("cjk-e", 0x2B820, 0x2CEAF, 5774), ("cjk-f", 0x2CEB0, 0x2EBEF, 7473), ("cjk-g", 0x30000, 0x3134F, 4939), ("cjk-h", 0x31350, 0x323AF, 4192), ("cjk-i", 0x2EBF0, 0x2EE5F, 622), ("cjk-j", 0x323B0, 0x3347F, 4298),
        ("radicals-sup", 0x2E80, 0x2EFF, 115), ("kangxi", 0x2F00, 0x2FDF, 214), ("strokes", 0x31C0, 0x31EF, 38), ("compat", 0xF900, 0xFAFF, 472), ("compat-sup", 0x2F800, 0x2FA1F, 542),
        ("tangut", 0x17000, 0x187FF, 6144), ("tangut-comp", 0x18800, 0x18AFF, 768), ("tangut-sup", 0x18D00, 0x18D7F, 31), ("tangut-comp-sup", 0x18D80, 0x18DFF, 115), ("khitan-small", 0x18B00, 0x18CFF, 470),
        ("punct", 0x3000, 0x303F, 64), ("enclosed", 0x3200, 0x32FF, 255), ("enclosed-sup", 0x1F200, 0x1F2FF, 64), ("ideo-symbols", 0x16FE0, 0x16FFF, 7), ("pua", 0xE000, 0xF8FF, 0), ("pua-plane15", 0xF0000, 0xFFFFD, 0),
    ),
)
SUPPLEMENTS = ("radicals-sup", "kangxi", "strokes", "compat", "compat-sup", "punct")
PRIVATE_FROM = 0x100000


def with_block(rows: DataFrame, cp: str = "cp") -> DataFrame:
    """Rows with the name of the block of a code point, else ``unknown``: a range join with the blocks, which are disjoint."""
    blocks = F.broadcast(BLOCKS.df(rows.sparkSession).select(F.col("name").alias("block"), F.col("begin").alias("_b"), F.col("end").alias("_e")))
    joined = rows.join(blocks, F.col(cp).between(F.col("_b"), F.col("_e")), "left")
    return joined.withColumn("block", F.coalesce("block", F.lit("unknown"))).drop("_b", "_e")


def block_coverage(rows: DataFrame, cp: str = "cp") -> DataFrame:
    """Per block: characters present and expected."""
    present = with_block(rows, cp).groupBy("block").agg(F.count("*").alias("n"))
    return BLOCKS.df(rows.sparkSession).select(F.col("name").alias("block"), "expected").join(present, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"), "expected")


def is_private(block: Column) -> Column:
    return block.startswith("pua")


def is_user_private(cp: Column, block: Column) -> Column:
    return (block == "pua") & (cp >= 0xF000)


def character_sets(tygf: Column, gb2312: Column, block: Column) -> dict[str, Column]:
    """Predicates of the eight sets, over the standards' levels and the block."""
    han = block.startswith("cjk")
    return {
        "minimal": (gb2312 > 0) & (tygf > 0), "gb2312": gb2312 > 0, "general": tygf > 0, "basic": (tygf > 0) | (block == "cjk"),
        "extended": (tygf > 0) | han, "supplement": (tygf > 0) | han | block.isin(*SUPPLEMENTS), "panlingual": ~is_private(block), "maximal": F.lit(True),
    }


def next_free_code_point(used: DataFrame, first: int = 0xF000, last: int = 0xF8FF, otherwise: int = 0xFFFF) -> DataFrame:
    """(cp): the least private code point that is free."""
    every = used.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("cp"))
    return every.join(used.select(F.col("cp").cast("int").alias("cp")), "cp", "left_anti").agg(F.coalesce(F.min("cp"), F.lit(otherwise)).alias("cp"))


def allocate_private(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with a private code point each, by their order, so that repeated runs agree."""
    from pyspark.sql import Window

    return rows.withColumn("cp", (F.row_number().over(Window.orderBy(*order)) - 1 + PRIVATE_FROM).cast("int"))
