"""Queries of the glyph domain over small synthetic glyphs (binding F), and assembly over part names (binding T).

Kernels of geometry, matching and priority lists aren't SQL; where a result was derived by hand it stands
as the oracle's literal, and tests hold the kernels against brute force.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions.fixtures import Fixture
from glyphmill.operators import analysis, analyzers, assembly, mapping
from glyphmill.operators.matching import Component, Piece, Scheme
from glyphmill.operators.priority import Guarded, join
from glyphmill.queries.statistics import PARTS, parts
from glyphmill.streaming import typing_stream


def stroke(feature: str, x: float, y: float, *curves: tuple) -> list:
    return [feature, [x, y], [[c, list(p)] for c, *p in curves]]


H, V = "横", "竖"
#: Synthetic components of straight and curved strokes.
COMPONENTS = {
    "cross": [stroke(H, 10, 50, ("h", 80)), stroke(V, 50, 10, ("v", 80))],
    "earth": [stroke(H, 20, 30, ("h", 60)), stroke(V, 50, 10, ("v", 80)), stroke(H, 10, 90, ("h", 80))],
    "two": [stroke(H, 20, 30, ("h", 60)), stroke(H, 10, 90, ("h", 80))],
    "king": [stroke(H, 20, 10, ("h", 60)), stroke(H, 20, 50, ("h", 60)), stroke(V, 50, 10, ("v", 80)), stroke(H, 10, 90, ("h", 80))],
    "big": [stroke(H, 10, 30, ("h", 80)), stroke("撇", 50, 10, ("c", 0, 30, -10, 60, -40, 80)), stroke("捺", 50, 30, ("c", 5, 20, 15, 40, 40, 60))],
    "sky": [stroke(H, 20, 10, ("h", 60)), stroke(H, 10, 30, ("h", 80)), stroke("撇", 50, 10, ("c", 0, 30, -10, 60, -40, 80)), stroke("捺", 50, 30, ("c", 5, 20, 15, 40, 40, 60))],
    "mouth": [stroke(V, 20, 20, ("v", 60)), stroke("横折", 20, 20, ("h", 60), ("v", 60)), stroke(H, 20, 80, ("h", 60))],
}
FX_COMPONENTS = Fixture("name string, strokes string", tuple((k, json.dumps(v, ensure_ascii=False)) for k, v in COMPONENTS.items()))
ROOTS = {k: json.dumps(COMPONENTS[k], ensure_ascii=False) for k in ("cross", "earth", "two", "big")}
SETTINGS = analyzers.Settings(mapped={"1", "2", "3", "4", "5", "cross", "two", "big"}, optional={"two"}, compound_roots={"twin"})


def stroke_topology(spark, d):
    return analysis.topology(FX_COMPONENTS.df(spark).where("name IN ('cross', 'earth', 'two', 'mouth')"))


def root_containment(spark, d):
    return analysis.containment(FX_COMPONENTS.df(spark), ROOTS)


def component_analysis(spark, d):
    return analysis.best_schemes(analysis.analyse_components(FX_COMPONENTS.df(spark), ROOTS, SETTINGS))


def component_counts(spark, d):
    return analysis.component_counts(analysis.analyse_components(FX_COMPONENTS.df(spark), ROOTS, SETTINGS))


def affine_merge(spark, d):
    """Start points of strokes of merged parts."""
    at = lambda rows: analysis.strokes_from_json(json.dumps(rows))
    h, v = at([stroke(H, 20, 50, ("h", 60))]), at([stroke(V, 50, 10, ("v", 80))])
    c = at([stroke("点", 10, 10, ("c", 10, 20, 20, 30, 40, 40))])
    cases = [("⿰", [h, v], []), ("⿱", [h, v], []), ("⿴", [v, c], [(1, 1), (0, 0)]), ("⿻", [h, v], [])]
    rows = [(op, k, float(s["start"][0]), float(s["start"][1])) for op, p, order in cases for k, s in enumerate(G.merge(op, p, order))]
    return spark.createDataFrame(rows, "operator string, stroke int, x double, y double")


def _results():
    s = lambda roots, firsts: analyzers.Result(roots, Scheme(tuple(Piece(r, 0, (i,)) for r, i in zip(roots, firsts))))
    return {"a": s(["a1", "a2"], [0, 2]), "b": s(["b1"], [0]), "c": s(["c1", "c2", "c3"], [0, 1, 3])}


def compound_roots(spark, d):
    """Root sequences of compounds by each registered analyzer that needs no further analysis of components."""
    part = {k: Component(k, []) for k in "abc"}
    settings = analyzers.Settings(mapped={"twin"}, compound_roots={"twin", "lost"}, classes_of_root={r: [1, 2] for r in ("a1", "a2", "b1", "c1", "c2", "c3", "twin", "lost")})
    twin = analyzers.Compound("twin", "⿰", [part["a"], part["b"]])
    glyphs = [
        analyzers.Compound("row", "⿰", [part["a"], part["c"]]), analyzers.Compound("woven", "⿴", [part["a"], part["c"]], [(0, 2), (1, 0), (0, 0)]), twin,
        analyzers.Compound("open", "⿶", [part["a"], part["b"]]), analyzers.Compound("deep", "⿱", [twin, part["c"]]), analyzers.Compound("lost", "⿱", [part["b"], part["c"]]),
    ]
    rows = []
    for name in ("默认", "真码", "首右", "二笔", "星空键道", "张码"):
        run = analyzers.COMPOUNDS[name](settings, _results())
        rows += [(name, g.name, " ".join(run.analyse(g).roots)) for g in glyphs]
    return spark.createDataFrame(rows, "analyzer string, compound string, roots string")


def priority_join(spark, d):
    """Combinations of two priority lists."""
    first = [Guarded(("p",), "a1"), Guarded((), "a2")]
    second = [Guarded(("p", "q"), "b1"), Guarded(("q",), "b2"), Guarded((), "b3")]
    rows = [(k, g.value, " ".join(g.conditions)) for k, g in enumerate(join([first, second], " ".join))]
    return spark.createDataFrame(rows, "place int, parts string, conditions string")


def decision_space(spark, d):
    """A generated decision space: generators, variables and required elements."""
    made = mapping.generate_space(
        {"A": "f", "B": {"element": "A"}, "C": [{"element": "A", "index": 0}, "x"]}, {"A": [{"value": "g", "score": 1, "condition": []}], "D": [{"value": None, "score": 2, "condition": []}]},
        [{"regex": "^A", "value": [{"variable": "v"}, None], "score": 3}], {"v": ["p", "q"]},
    )
    rows = [(n, k, json.dumps(e["value"]), e["score"], " ".join(c["element"] for c in e["condition"])) for n, es in made.items() for k, e in enumerate(es)]
    return spark.createDataFrame(rows, "element string, place int, value string, score int, requires string")


def assemble_words(spark, d):
    """Part names assembled from analyses of their tokens: two alternatives for tokens that begin with c, positions by a rule for two tokens."""
    lex = parts(spark, d).select(F.col("ord").cast("bigint").alias("ord"), "word", "chars", F.col("chars").alias("pinyin"), "freq")
    tokens = lex.select(F.explode("chars").alias("char")).distinct()
    letters = lambda c: F.array(F.substring(c, 1, 1), F.substring(c, -1, 1))
    alts = tokens.select("char", F.lit(0).alias("alt"), letters(F.col("char")).alias("seq")).unionByName(tokens.where(F.col("char").startswith("c")).select("char", F.lit(1).alias("alt"), F.array(F.lit("*"), F.substring("char", 2, 1)).alias("seq")))
    made = assembly.assemble(lex, alts, [{"length_equal": 2, "formula": "AaBaAbBb"}])
    return made.select("word", "seq", "freq", F.size("pinyin").alias("n"), "ord")


QUERIES = {
    f.__name__: f
    for f in (stroke_topology, root_containment, component_analysis, component_counts, affine_merge, compound_roots, priority_join, decision_space, assemble_words, typing_stream.tumbling_counts)
}

SQL = {
    "affine_merge": "SELECT operator, stroke, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES ('⿰', 0, 20.0, 50.0), ('⿰', 1, 100.0, 10.0), ('⿱', 0, 20.0, 50.0), ('⿱', 1, 50.0, 70.0), ('⿴', 0, 30.0, 30.0), ('⿴', 1, 50.0, 10.0), ('⿻', 0, 20.0, 50.0), ('⿻', 1, 50.0, 10.0)) v(operator, stroke, x, y)",
    "priority_join": "SELECT * FROM (VALUES (0, 'a1 b1', 'p q'), (1, 'a1 b3', 'p'), (2, 'a2 b2', 'q'), (3, 'a2 b3', '')) v(place, parts, conditions)",
    "assemble_words": f"""WITH {PARTS}, t AS (SELECT DISTINCT unnest(string_split(word, ' ')) AS c FROM p),
        alt AS (SELECT c, 0 AS k, left(c, 1) AS x, right(c, 1) AS y FROM t UNION ALL SELECT c, 1, '*', substr(c, 2, 1) FROM t WHERE starts_with(c, 'c'))
        SELECT word, a.x || ' ' || b.x || ' ' || a.y || ' ' || b.y AS seq, sum(freq) AS freq, CAST(count(*) AS INTEGER) AS n, min(ord) AS ord
        FROM p JOIN alt a ON a.c = split_part(word, ' ', 1) JOIN alt b ON b.c = split_part(word, ' ', 2) GROUP BY 1, 2""",
    "tumbling_counts": typing_stream.SQL,
}
