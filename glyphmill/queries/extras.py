"""Queries of the smaller operators: universes of names, filters, checks, recommendations, options, dynamic assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions.codes import position_text
from glyphmill.functions.fixtures import Fixture
from glyphmill.operators import assembly, graphs, mapping, search
from glyphmill.queries.statistics import PARTS, part_codes
from glyphmill.queries.structures import FX_CHARS, FX_MAPPING, FX_POSITIONS, MAP

CHARS = f"c AS ({FX_CHARS.sql()})"
FX_CUSTOM = Fixture("name string", (("x-1",), ("一",), ("12",)))
FX_ELEMENTS = Fixture("element string", (("initial-l",), ("tone-1",), ("x-1",)))


def legal_elements(spark, d):
    """The universe of names, counted by kind."""
    every = mapping.legal_elements(FX_CHARS.df(spark).select(F.col("char").alias("name")), 5, FX_ELEMENTS.df(spark), FX_CUSTOM.df(spark))
    return every.groupBy("kind").agg(F.count("*").alias("n"))


def resolve_mapping_names(spark, d):
    """Arrangements whose references are known, with the kind of their element."""
    universe = FX_MAPPING.df(spark).where("element NOT IN ('E', 'G')").select(F.col("element").alias("name"), F.lit("character").alias("kind"))
    return mapping.resolve_names(FX_MAPPING.df(spark), FX_POSITIONS.df(spark), universe).select("element", "kind", "element_kind")


def position_texts(spark, d):
    return FX_POSITIONS.df(spark).select("element", "pos", position_text(F.col("key"), F.col("ref"), F.col("idx")).alias("text"))


FX_GROUPS = Fixture("members string", (("土士", ), ("木林森",), ("一㇀",)))


def root_recommendation(spark, d):
    """For each mapped member of a group of look-alikes, the others."""
    members = FX_GROUPS.df(spark).select(F.col("members").alias("g"), F.explode(F.filter(F.split("members", ""), lambda c: c != "")).alias("char"))
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.char") != F.col("b.char"))).select(F.col("a.char").alias("root"), F.col("b.char").alias("suggested"))


def key_options(spark, d):
    """Positions of elements that aren't merged, as options of a key."""
    m = FX_MAPPING.df(spark).where("kind = 'str'")
    return m.select("element", F.explode(F.sequence(F.lit(0), F.length("keys") - 1)).alias("index"))


FX_ORDERS = Fixture("char string, source string, strokes string", (("一", "first", "1"), ("二", "first", "12"), ("土", "second", "121"), ("木", "second", "1243"), ("一", "second", "2"), ("林", "second", "12341234")))


def stroke_order_check(spark, d):
    """Characters whose strokes differ from the first list that has them."""
    lists = FX_ORDERS.df(spark)
    pick = lambda s: lists.where(F.col("source") == s).select("char", F.col("strokes").alias(s))
    rows = FX_CHARS.df(spark).join(pick("first"), "char", "left").join(pick("second"), "char", "left").withColumn("want", F.coalesce("first", "second"))
    return rows.where("want IS NOT NULL AND want <> strokes").select("char", "strokes", "want")


def analysis_filter(spark, d):
    rows = FX_CHARS.df(spark).select(F.col("char").alias("name"), F.split(F.coalesce("parts", F.substring("strokes", 1, 1)), " ").alias("roots"))
    necessary = FX_CHARS.df(spark).where("gb2312 = 2").select(F.col("char").alias("name"))
    return search.analysis_rows(rows, necessary, skip_single=True).select("name")


def code_row_filter(spark, d):
    """Part names by patterns on their codes and the key at a position."""
    rows = part_codes(spark, d).select("word", F.col("code").alias("full"), F.substring("code", 1, 1).alias("short"), F.split("code", "").alias("seq"))
    return search.code_rows(rows, word="^[a-m]", full=".[a-p]$", positions={0: "b"}, short_length=1).select("word", "full")


def objective_split(spark, d):
    rows = part_codes(spark, d).select("word", F.split("word", " ").alias("chars"), F.col("code").alias("full"), F.substring("code", 1, 1).alias("short"))
    return search.objective_rows(rows, "words_short").groupBy("code").agg(F.count("*").alias("n"))


def custom_order(spark, d):
    """Regions by a custom order; others first."""
    rows = spark.read.parquet(f"{d}/region.parquet")
    return rows.select("r_name", search.by_list(F.col("r_name"), ["EUROPE", "ASIA"]).cast("int").alias("place"))


FX_NODES = Fixture("node string, ref string", (("s0", "s1"), ("s1", "c1"), ("c1", "s2"), ("c1", "s3"), ("s9", "s2")))


def reachable_nodes(spark, d):
    """Nodes of a code path that are never reached from its start."""
    edges = FX_NODES.df(spark)
    edges.createOrReplaceTempView("glyphmill_path")
    reached = spark.sql("WITH RECURSIVE r (node, depth) AS (SELECT 's0', 0 UNION ALL SELECT p.ref, r.depth + 1 FROM r JOIN glyphmill_path p ON p.node = r.node WHERE r.depth < 50) SELECT DISTINCT node FROM r")
    every = edges.select("node").union(edges.select("ref")).distinct()
    return every.join(reached, "node", "left_anti")


def dynamic_assembly(spark, d):
    """Words of priority lists, under conditions."""
    words = spark.createDataFrame([(0, "ab", ["a", "b"]), (1, "a", ["a"]), (2, "abz", ["a", "b", "z"])], "ord bigint, word string, chars array<string>")
    lists = spark.createDataFrame([("a", 0, ["p"], ["1", "2"]), ("a", 1, [], ["3"]), ("b", 0, ["p", "q"], ["4"]), ("b", 1, ["q"], ["5", "6"]), ("b", 2, [], ["7"])], "char string, place int, conditions array<string>, seq array<string>")
    return assembly.assemble_dynamic(words, lists, [{"length_equal": 2, "formula": "AaBaAb"}]).select("word", "seq", "conditions", "place")


def customer_classes(spark, d):
    """Customers and nations as one graph: classes are the nations' regions (binding T of the partition)."""
    c = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1000).alias("a"), F.col("c_nationkey").cast("bigint").alias("b"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("a"), (F.col("n_regionkey") - 10).cast("bigint").alias("b"))
    links = c.unionByName(n)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return graphs.partition(nodes, links).groupBy("class").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        legal_elements, resolve_mapping_names, position_texts, root_recommendation, key_options, stroke_order_check, analysis_filter, code_row_filter, objective_split, custom_order, reachable_nodes, dynamic_assembly, customer_classes,
    )
}

SQL = {
    "legal_elements": f"""WITH {CHARS}, u AS (SELECT char AS name, 'character' AS kind, 0 AS k FROM c UNION ALL SELECT CAST(a AS VARCHAR), 'stroke', 1 FROM range(1, 6) r(a) UNION ALL SELECT a || '' || b, 'two strokes', 2 FROM range(1, 6) r(a), range(0, 6) s(b)
        UNION ALL SELECT unnest(string_split('⿰⿱⿲⿳⿴⿵⿶⿷⿸⿹⿺⿻⿼⿽⿾⿿', '')), 'structure', 3 UNION ALL SELECT unnest(['initial-l', 'tone-1', 'x-1']), 'syllable', 4 UNION ALL SELECT unnest(['x-1', '一', '12']), 'custom', 5)
        SELECT kind, count(*) AS n FROM (SELECT name, arg_max(kind, k) AS kind FROM u WHERE name <> '' GROUP BY 1) GROUP BY 1""",
    "resolve_mapping_names": f"""WITH {MAP}, u AS (SELECT element FROM m WHERE element NOT IN ('E', 'G')), bad AS (SELECT element FROM p WHERE ref IS NOT NULL AND ref NOT IN (FROM u) UNION SELECT element FROM m WHERE merge_to IS NOT NULL AND merge_to NOT IN (FROM u))
        SELECT element, kind, CASE WHEN element IN (FROM u) THEN 'character' ELSE 'unknown' END AS element_kind FROM m WHERE element NOT IN (FROM bad)""",
    "position_texts": f"WITH {MAP} SELECT element, pos, CASE WHEN ref IS NOT NULL THEN ref || '.' || idx WHEN key IS NOT NULL THEN key ELSE 'ε' END AS text FROM p",
    "root_recommendation": "SELECT * FROM (VALUES ('土', '士'), ('士', '土'), ('木', '林'), ('木', '森'), ('林', '木'), ('林', '森'), ('森', '木'), ('森', '林'), ('一', '㇀'), ('㇀', '一')) v(root, suggested)",
    "key_options": f"WITH {MAP} SELECT element, CAST(unnest(range(0, length(keys))) AS INTEGER) AS index FROM m WHERE kind = 'str'",
    "stroke_order_check": f"WITH {CHARS}, o AS ({FX_ORDERS.sql()}) SELECT c.char, c.strokes, coalesce(f.strokes, s.strokes) AS want FROM c LEFT JOIN o f ON f.char = c.char AND f.source = 'first' LEFT JOIN o s ON s.char = c.char AND s.source = 'second' WHERE coalesce(f.strokes, s.strokes) <> c.strokes",
    "analysis_filter": f"WITH {CHARS} SELECT char AS name FROM c WHERE gb2312 <> 2 AND NOT (parts IS NULL AND regexp_full_match(substr(strokes, 1, 1), '[1-7]'))",
    "code_row_filter": f"WITH {PARTS} SELECT word, code AS \"full\" FROM pc WHERE regexp_matches(word, '^[a-m]') AND regexp_matches(code, '.[a-p]$') AND substr(code, 1, 1) = 'b'",
    "objective_split": f"WITH {PARTS} SELECT substr(code, 1, 1) AS code, count(*) AS n FROM pc GROUP BY 1",
    "custom_order": "SELECT r_name, CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 0 END AS place FROM region",
    "reachable_nodes": "SELECT 's9' AS node",
    "dynamic_assembly": "SELECT * FROM (VALUES ('ab', '1 4 2', 'p q', 0), ('ab', '1 7 2', 'p', 1), ('ab', '3 5', 'q', 2), ('ab', '3 7', '', 3), ('a', '1 2', 'p', 0), ('a', '3', '', 1)) v(word, seq, conditions, place)",
    "customer_classes": "SELECT CAST(n_regionkey - 10 AS BIGINT) AS class, 1 + count(DISTINCT n_nationkey) + count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
}
