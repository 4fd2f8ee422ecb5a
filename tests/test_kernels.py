"""Kernels against golden values and brute force."""

import json
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import codes, geometry, pinyin, strokes
from glyphmill.operators import analyzers, codepath, glyphs, graphs, lexicon, mapping, matching, priority, search, selectors, timing
from glyphmill.plans import registry
from glyphmill.queries.domain import COMPONENTS
from glyphmill.operators.analysis import strokes_from_json
from glyphmill.sources import tables


def component(name):
    return matching.Component(name, strokes_from_json(json.dumps(COMPONENTS[name])))


def test_intervals():
    assert [geometry.compare(*x) for x in (((10, 20), (30, 40)), ((10, 20), (20, 40)), ((50, 40), (30, 40)), ((50, 70), (30, 40)), ((10, 30), (14, 25)))] == [-1, -0.5, 0.5, 1, 0]


def test_curves():
    at = lambda c, *p: geometry.chain({"start": (12, 34), "curves": [(c, p)]})[0]
    assert at("c", 5, 8, 23, 15, 49, 33).at(1) == (61, 67)
    assert at("h", 10).at(1) == (22, 34) and at("v", 20).at(1) == (12, 54)
    a, b = at("c", 5, 8, 23, 15, 49, 33).halves()
    assert a.ends[1] == b.ends[0] == at("c", 5, 8, 23, 15, 49, 33).at(0.5)
    assert at("a", 9).at(0.3) == (0, 0) and at("a", 9).ends == ((12, 34), (12, 34))


def test_topology_of_a_cross_shape():
    t = geometry.topology(strokes_from_json(json.dumps([["横", [20, 30], [["h", [60]]]], ["竖", [50, 10], [["v", [80]]]], ["横", [10, 90], [["h", [80]]]]])))
    assert t.matrix[1][0] == (("cross",),)
    assert t.matrix[2][1] == (("touch", "middle", "back"),)
    assert t.matrix[2][0][0][:2] == ("parallel", 0) and t.oriented == {(2, 0)}


def test_curved_strokes_cross_and_touch():
    line = geometry.chain({"start": (0, 50), "curves": [("h", (100,))]})[0]
    curve = geometry.chain({"start": (50, 0), "curves": [("c", (0, 30, 10, 60, 0, 100))]})[0]
    short = geometry.chain({"start": (50, 0), "curves": [("c", (0, 20, 5, 40, 0, 51))]})[0]
    circle = geometry.chain({"start": (50, 50), "curves": [("a", (10,))]})[0]
    assert geometry.relation(line, curve) == ("cross",)
    assert geometry.relation(line, short)[0] == "touch"
    assert geometry.relation(line, circle)[0] in ("touch", "cross", "parallel", "perpendicular")


def test_placing_parts():
    h = [{"feature": "横", "start": (20, 50), "curves": [("h", [60])]}]
    v = [{"feature": "竖", "start": (50, 10), "curves": [("v", [80])]}]
    assert geometry.merge("⿰", [h, v])[1]["start"] == (100, 10)
    assert geometry.merge("⿰", [h, v], gaps=(50,))[1]["start"] == (130, 10)
    inner = [{"feature": "点", "start": (10, 10), "curves": [("c", [10, 20, 20, 30, 40, 40])]}]
    first = geometry.merge("⿴", [v, inner], [(1, 1), (0, 0)])[0]
    assert first["start"] == (30, 30) and list(first["curves"][0][1]) == [5, 10, 10, 15, 20, 20]


def test_masks():
    assert codes.mask_of([0, 1, 3], 5) == 26 and codes.indices_of(19, 5) == [0, 3, 4]
    for n in range(1, 9):
        assert all(codes.mask_of(codes.indices_of(m, n), n) == m for m in range(1 << n))


def test_stroke_names():
    assert len(strokes.CLASS_OF) == len(strokes.COMMANDS_OF) == 41 and set(strokes.CLASS_OF) == set(strokes.COMMANDS_OF)
    assert strokes.classifier({"提": 6})["提"] == 6 and strokes.COMMANDS_OF["横折折折钩"] == tuple("hvhv")
    assert strokes.valid({"feature": "横", "curves": [("h", [1])]}) and not strokes.valid({"feature": "横", "curves": [("v", [1])]})


def test_covers_of_the_golden_masks():
    masks = [1, 2, 3, 4, 6, 8, 9, 12, 14]
    assert matching.interval_sums(masks, 4) == {3, 6, 12, 14}
    assert matching.exact_covers(masks, 4, prune=True) == [(9, 6), (12, 3), (14, 1)]
    assert matching.exact_covers(masks, 4) == [(8, 4, 2, 1), (8, 4, 3), (8, 6, 1), (9, 4, 2), (9, 6), (12, 2, 1), (12, 3), (14, 1)]


def test_covers_equal_brute_force():
    pick = random.Random(3)
    for _ in range(60):
        n = pick.randrange(1, 6)
        masks = pick.sample(range(1, 1 << n), min((1 << n) - 1, 7))
        found = {frozenset(c) for c in matching.exact_covers(masks, n)}
        want = {frozenset(c) for r in range(1, len(masks) + 1) for c in combinations(masks, r) if sum(c) == (1 << n) - 1 and all(not a & b for a, b in combinations(c, 2))}
        assert found == want


def brute_containment(c, r):
    same = lambda s: strokes.DEGENERATE.get(s["feature"], s["feature"])
    out = []
    for chosen in combinations(range(len(c)), len(r)):
        if all(same(c.strokes[i]) == same(s) for i, s in zip(chosen, r.strokes)) and all(c.topology.matrix[chosen[k]][chosen[j]] == r.topology.matrix[k][j] for k in range(len(r)) for j in range(k)):
            out.append(codes.mask_of(list(chosen), len(c)))
    return out


def test_containment_equals_brute_force():
    for a, b in product(COMPONENTS, COMPONENTS):
        assert matching.contained(component(a), component(b)) == brute_containment(component(a), component(b))
    assert matching.contained(component("sky"), component("big")) == [7]
    assert matching.contained(component("earth"), component("cross"), no_cross=True) == [6]


def test_lengths_tell_roots_apart():
    up = matching.Component("up", component("earth").strokes)
    down = matching.Component("down", [{**up.strokes[0], "start": (0, 30), "curves": [("h", [100])]}, *up.strokes[1:2], {**up.strokes[2], "start": (40, 90), "curves": [("h", [20])]}])
    for root, fits in (("土", up), ("士", down)):
        r = matching.Component(root, fits.strokes)
        assert matching.contained(fits, r) == [7]
    assert matching.contained(up, matching.Component("士", up.strokes)) == []


def test_selectors_on_the_sky():
    sky, big = component("sky"), component("big")
    a = matching.analyse(sky, [big], {"1", "2", "3", "4", "5", "big"}, set(), selectors.DEFAULT_CHAIN, selectors.REGISTRY)
    assert a.roots == ("1", "big") and [p.mask for p in a.current.pieces] == [8, 7]
    env = matching.Environment(sky, {8: "1", 7: "big"}, frozenset({"big"}), frozenset({"big"}), frozenset({"1"}))
    s = a.current
    got = {name: f(s, env) for name, f in selectors.REGISTRY.items()}
    assert (got["根少优先"], got["取大优先"], got["倒序取大"], got["取小优先"], got["全符笔顺"], got["连续笔顺"]) == ([2], [-1, -3], [-3, -1], [1, 3], [0], [0])
    assert (got["非形近根"], got["多强字根"], got["少弱字根"], got["能连不交"], got["能散不连"]) == ([1], [-1], [1], [0], [1])
    with pytest.raises(matching.NoScheme):
        matching.analyse(sky, [big], {"1"}, set(), selectors.DEFAULT_CHAIN, selectors.REGISTRY)


def test_ranking_and_usable_schemes():
    c = component("king")
    masks = matching.mask_roots(c, [component("cross"), component("two")])
    found = matching.schemes(c, masks)
    ranked = matching.rank(found, matching.Environment(c, masks), ["根少优先", "no such selector", "取大优先"], {"1", "2", "cross"}, selectors.REGISTRY)
    keys = [[s.scores[n] for n in s.scores] for s in ranked]
    assert keys == sorted(keys) and set(ranked[0].scores) == {"根少优先", "取大优先"}
    assert all(sum(p.mask for p in s.pieces) == 15 for s in ranked)
    first_plain = next(k for k, s in enumerate(ranked) if set(s.roots) <= {"1", "2", "cross"})
    assert ranked[0].usable and not any(s.usable for s in ranked[first_plain + 1 :])


def test_component_analyzers():
    a = matching.analyse(component("sky"), [component("big")], {"1", "2", "3", "4", "5", "big"}, {"big"}, selectors.DEFAULT_CHAIN, selectors.REGISTRY)
    s = analyzers.Settings(mapped={"1", "3", "4", "big"}, optional={"big"}, classes_of_root={"big": [1, 3, 4]}, small={"1", "3", "4"})
    assert analyzers.default_component(a, s).roots == ["1", "big"]
    assert analyzers.default_component(a, analyzers.Settings(set(), custom={"sky": ["x"]})).roots == ["x"]
    rows = analyzers.default_component_dynamic(a, s)
    assert rows[0].conditions == (("present", "big"),) and rows[-1].conditions == ()
    assert analyzers.two_stroke_component(a, s).roots == ["11", "4"]
    assert analyzers.complement_component(a, s).extra == {"complement": "41", "quasi_root": False}
    assert analyzers.limited_component(a, s).roots == ["1", "big"] + ["10", "30", "40", "40", "40", "40"]
    assert analyzers.limited_component(a, s).extra["forms"][1] == (["1", "10", "30", "40"], ["40"] * 6)
    assert analyzers.small_set_component(a, s).roots == ["1", "1", "3"]
    assert analyzers.complement(["1"], s) == "61" and analyzers.complement(["1", "big"], s, "⿰") == "14"


def test_compounds_by_blocks():
    piece = lambda firsts: matching.Scheme(tuple(matching.Piece("r", 0, (i,)) for i in firsts))
    parts = [(["a1", "a2"], piece([0, 2])), (["b1"], piece([0]))]
    assert analyzers.by_blocks(parts, [(0, 2), (1, 0), (0, 0)]) == ["a1", "b1", "a2"]
    assert analyzers.by_blocks(parts, [(0, 0), (7, 1), (1, 3)]) == ["a1", "a2", "b1"]
    assert analyzers.by_blocks([(["a1", "a2"], None), parts[1]], [(0, 1), (1, 1)]) == ["a1", "a2", "b1"]


def brute_first(lists, facts):
    """What priority lists give under given facts, list by list."""
    out = []
    for rows in lists:
        row = next((r for r in rows if set(r.conditions) <= facts), None)
        if row is None:
            return None
        out.append(row.value)
    return out


def test_priority_join_equals_choosing_list_by_list():
    pick = random.Random(5)
    for _ in range(200):
        lists = []
        for _ in range(pick.randrange(1, 4)):
            rows = [priority.Guarded(tuple(pick.sample("pqr", pick.randrange(0, 3))), pick.randrange(100)) for _ in range(pick.randrange(1, 4))]
            lists.append([*rows, priority.Guarded((), -1)])
        joined = priority.join(lists, list)
        for n in range(4):
            for facts in combinations("pqr", n):
                assert priority.first_that_holds(joined, set(facts)) == brute_first(lists, set(facts))


def test_mapping_errors_and_space(spark):
    kinds = "element string, ord int, kind string, keys string, merge_to string"
    cells = spark.createDataFrame([], "element string, pos int, key string, ref string, idx int")
    with pytest.raises(mapping.MappingError):
        mapping.linearise(spark.createDataFrame([("A", 0, "merge", None, "B"), ("B", 1, "merge", None, "A")], kinds), cells)
    with pytest.raises(mapping.MappingError):
        mapping.linearise(spark.createDataFrame([("A", 0, "merge", None, "Z")], kinds), cells)
    made = mapping.generate_space({"A": "f", "C": [{"element": "A", "index": 0}, "x"]}, {}, [{"regex": "^A", "value": [{"variable": "v"}], "score": 3}], {"v": ["p", "q"]})
    assert [e["value"] for e in made["A"]] == ["f", "p", "q"] and [e["score"] for e in made["A"]] == [0, 3, 3]
    assert made["C"][0]["condition"] == [{"element": "A", "op": "is not", "value": None}]


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    with pytest.raises(graphs.CycleError, match="a, b"):
        graphs.topological_levels(spark, nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "node string, ref string"))
    with pytest.raises(codepath.CodePathError):
        codepath.compile_path({"s0": {"next": "s1"}, "s1": {"object": {"type": "char"}, "next": "s1"}}, {}, {})


@pytest.mark.parametrize("operator,absent,known", [("is", False, True), ("is not", True, False), ("matches", False, True), ("matches not", False, False), ("is present", False, True), ("is absent", True, False)])
def test_predicates(spark, operator, absent, known):
    rows = spark.createDataFrame([(0, None), (1, "x")], "k int, e string")
    got = {r.k: r.v for r in rows.select("k", codepath.holds(operator, F.col("e"), "x", F.lit(None).cast("string")).alias("v")).collect()}
    assert got == {0: absent, 1: known}


def test_formula_letters_and_positions(spark):
    assert [codes.formula_index(c) for c in "amnz"] == [0, 12, -13, -1]
    row = spark.range(1).select(*[codes.signed_element(F.array(F.lit("a"), F.lit("b")), k).alias(f"k{k % 7}") for k in (0, 1, -1, 3)]).first()
    assert tuple(row) == (None, "a", "b", None)


def test_syllables(spark):
    want = {"zhong1": ("zh", "ong", "1", "z", "g"), "xue2": ("x", "ve", "2", "x", "e"), "wu3": ("0", "u", "3", "w", "u"), "gui4": ("g", "uei", "4", "g", "i"), "an1": ("0", "an", "1", "a", "n"), "lun2": ("l", "uen", "2", "l", "n"), "yu2": ("0", "v", "2", "y", "u"), "you3": ("0", "iou", "3", "y", "u")}
    rows = pinyin.analyse(spark.createDataFrame([(s,) for s in want], "syllable string")).collect()
    assert {r.syllable: (r.initial, r.final, r.tone, r.first, r.last) for r in rows} == want


def test_erf_and_robust_means(spark):
    import math

    xs = [-2.5, -1.0, 0.0, 0.3, 1.7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(timing.erf(F.col("x"))).collect()
    assert all(abs(r[0] - math.erf(x)) < 2e-7 for r, x in zip(got, xs))
    rows = [("one", 5.0)] + [("same", 3.0)] * 4 + [("far", v) for v in (10.0, 11.0, 9.0, 10.5, 9.5, 10.0, 10.2, 9.8, 60.0)]
    out = {r.k: r for r in timing.robust_mean(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (out["one"].value, out["one"].std, out["one"].n) == (5.0, 0.0, 1)
    assert (out["same"].value, out["same"].n) == (3.0, 4)
    assert out["far"].n == 8 and out["far"].raw == 9 and abs(out["far"].value - 10.0) < 1e-9


def test_sources(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text("的\tde5\t100\n一\tyi1\t\nshort\trow\n二\ter4\tx\n三\tsan1\t7\n")
    table = tables.split_table(tables.read_lines(spark, str(path)))
    got = tables.dictionary(table).collect()
    assert [(r.word, r.pinyin, r.freq) for r in got] == [("的", ["de5"], 100.0), ("一", ["yi1"], 0.0), ("三", ["san1"], 7.0)]
    (tmp_path / "e.tsv").write_text("ab\t1.5\nab\t2\ncd\tx\n")
    assert [tuple(r) for r in tables.equivalence(tables.split_table(tables.read_lines(spark, str(tmp_path / "e.tsv")))).collect()] == [("ab", 2.0)]
    (tmp_path / "k.tsv").write_text("a\t1\t2\t3\nb\t1\t\t3\nc\t1\t2\n")
    assert {r.key for r in tables.key_targets(tables.split_table(tables.read_lines(spark, str(tmp_path / "k.tsv")))).collect()} == {"a", "b"}
    (tmp_path / "c.txt").write_text("ab 词\ncd 字\n")
    assert [(r.word, r.code) for r in tables.code_table(tables.read_lines(spark, str(tmp_path / "c.txt")), "space", word_first=False).collect()] == [("词", "ab"), ("字", "cd")]
    tables.write_tsv(tables.dictionary(table), ["word", "pinyin", "freq"], str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(["的\tde5\t100.0", "一\tyi1\t0.0", "三\tsan1\t7.0"])


def test_repertoire_file(spark, tmp_path):
    import zlib

    rows = [{"unicode": 19968, "tygf": 1, "gb2312": 1, "ambiguous": False, "glyphs": [{"type": "basic_component", "tags": ["G"], "strokes": []}]}, {"unicode": 20108, "tygf": 1, "gb2312": 1, "ambiguous": True, "glyphs": []}]
    (tmp_path / "r.deflate").write_bytes(zlib.compress(json.dumps(rows).encode()))
    user = spark.createDataFrame([(20108, 3)], "unicode int, tygf int")
    got = {r.unicode: r.tygf for r in tables.repertoire(spark, str(tmp_path / "r.deflate"), user).collect()}
    assert got == {19968: 1, 20108: 3}
    wire = tables.to_wire(tables.repertoire(spark, str(tmp_path / "r.deflate")))
    assert tables.from_wire(wire).where("unicode = 19968").first().glyphs[0].type == "basic_component"


def test_assembly_counts_variants(spark):
    rows = spark.createDataFrame([(0, "w", "p1", "a b", 2.0), (0, "w", "p1", "a b", 2.0), (1, "w", "p2", "a b", 3.0), (2, "v", "p3", "c", 1.0)], "ord bigint, word string, pinyin string, seq string, freq double")
    got = {(r.word, r.seq): (r.freq, r.pinyin, r.ord) for r in lexicon.dedup_assembly(rows).collect()}
    assert got == {("w", "a b"): (7.0, ["p1", "p1", "p2"], 0), ("v", "c"): (1.0, ["p3"], 2)}
    assert {r.freq for r in lexicon.dedup_assembly(rows, dedupe_variants=True).collect()} == {5.0, 1.0}


def test_glyphs_resolve_and_rewrite():
    bar = {"feature": "横", "start": (10, 50), "curves": [("h", [80])]}
    ds = {
        "a": [{"type": "basic_component", "tags": ["G"], "strokes": [bar]}, {"type": "basic_component", "tags": ["T"], "strokes": [bar, bar]}],
        "b": [{"type": "compound", "tags": ["G", "T"], "operator": "⿱", "operands": ["a", "a"]}], "c": [{"type": "identity", "source": "a", "tags": ["G"]}],
        "d": [{"type": "derived_component", "source": "a", "tags": ["T"], "strokes": [{"feature": "reference", "index": 1}, {"feature": "reference", "index": 9}, bar]}],
        "e": [{"type": "spliced_component", "tags": ["G"], "operator": "⿱", "operands": ["a", "a"]}],
    }
    done = glyphs.resolve(ds, [["a"], ["b", "c", "d", "e"]])
    assert [(sorted(t), len(g.parts[0])) for t, g in done["b"]] == [(["G"], 1), (["T"], 2)]
    assert len(done["c"]) == 1 and len(done["d"][0][1]) == 2 and len(done["e"][0][1]) == 2
    assert glyphs.find_component(done, "a-1") is done["a"][1][1] and glyphs.find_component(done, "a") is done["a"][0][1]
    assert set(glyphs.components_to_analyse([g for _, g in done["b"]])) == {"a"}
    x, y = glyphs.Variable(1), glyphs.Variable(2)
    of = {"p": [{"type": "compound", "operator": "⿰", "operands": ["u", "q"]}], "q": [{"type": "compound", "operator": "⿱", "operands": ["v", "u"]}]}
    old = glyphs.Pattern("⿰", (x, glyphs.Pattern("⿱", (y, x))))
    assert glyphs.unify(old, of["p"][0], of) == {1: "u", 2: "v"}
    made = glyphs.Rewriter(of).run([(old, glyphs.Pattern("⿱", (glyphs.Pattern("⿰", (x, y)), x)))])
    assert made["p"] == [{"type": "compound", "operator": "⿱", "operands": [chr(0x100000), "u"]}] and made[chr(0x100000)][0]["operands"] == ["u", "v"]
    with pytest.raises(ValueError):
        glyphs.Rewriter(of).run([(glyphs.Pattern("⿰", (x, y)), glyphs.Pattern("⿰", (glyphs.Variable(9), x)))])


def test_registry():
    assert {k: len(v) for k, v in registry.REGISTRY.items()} == {"selector": 14, "component analyzer": 5, "compound analyzer": 8, "assembler": 2, "pinyin analyzer": 1}
    with pytest.raises(registry.UnknownPlugin):
        registry.get("assembler", "none")
    registry.register("selector", "mine", selectors.fewest_roots)
    assert registry.get("selector", "mine") is selectors.fewest_roots
    del registry.REGISTRY["selector"]["mine"]


def test_searches(spark):
    rows = spark.createDataFrame([(1, "a", None, "12", "cjk"), (2, "b", "bee", "1", "cjk"), (3, "c", None, "123", "kangxi")], "cp int, char string, name string, strokes string, block string")
    assert [r.cp for r in search.element_pool(rows, "1").collect()] == [1]
    assert [r.cp for r in search.element_pool(rows, "(").collect()] == []
    table = spark.createDataFrame([("w", "abc", "a", ["x", "y"]), ("v", "bcd", "bc", ["x", "z"])], "word string, full string, short string, seq array<string>")
    assert [r.word for r in search.code_rows(table, full="^a").collect()] == ["w"] and [r.word for r in search.code_rows(table, positions={1: "z"}, short_length=2).collect()] == ["v"]


def test_compound_analyzers(spark):
    from glyphmill.queries.domain import compound_roots

    got = {(r.analyzer, r.compound): r.roots for r in compound_roots(spark, "").collect()}
    assert [got["默认", c] for c in ("row", "woven", "twin", "deep", "lost")] == ["a1 a2 c1 c2 c3", "a1 c1 c2 c3 a2", "twin", "twin c1 c2 c3", "b1 c1 c2 c3"]
    assert [got["真码", c] for c in ("open", "lost")] == ["b1 a1 a2", "lost"]
    assert [got["首右", c] for c in ("row", "woven", "deep", "lost")] == ["a1 c1", "a1 a2", "twin c3", "b1 c3"]
    assert [got["二笔", c] for c in ("row", "deep")] == ["a1 c1 c2 c3", "twin c1 c2 c3"]
    assert got["星空键道", "lost"] == "lost" and got["张码", "open"] == "b1 a1 a2"


def test_eyes_limits_and_radicals():
    from glyphmill.operators import analyzers
    from glyphmill.operators.matching import Component
    from glyphmill.operators.priority import Guarded

    part = {k: Component(k, []) for k in "abcdefgh"}
    a, b, c, d, e, f = (part[k] for k in "abcdef")
    roots = {k: [k + "1", k + "2"] for k in "abcd"} | {k: [k] for k in "ef"}
    made = lambda name, op, *parts, order=(): analyzers.Compound(name, op, list(parts), list(order))
    settings = analyzers.Settings(mapped={"tw", "sm", "big"}, compound_roots={"tw", "sm", "big", "un"}, small={"sm", "un"}, classes_of_root={r: [1, 2] for r in [*sum(roots.values(), []), "tw", "sm", "un", "big"]})
    results = {k: analyzers.Result(v, extra={"forms": {2: (v, ["p"]), 1: (v[:1], ["q"]), 0: (["s"], ["t"])}}) for k, v in roots.items()}
    run = lambda name, g: " ".join(analyzers.COMPOUNDS[name](settings, results).analyse(g).roots)
    eye, un = made("eye", "⿰", b, c), made("un", "⿰", b, c)
    three = made("three", "⿰", made("bc", "⿰", b, c), d)
    for glyph, want in (
        (made("x", "⿳", a, eye, d), "a1 a2 b1 d2"), (made("x", "⿳", e, eye, d), "e b1 c1 d2"), (made("x", "⿱", a, eye), "a1 a2 b1 b2 c1 c2"),
        (made("x", "⿱", eye, a), "b1 c1 a1 a2"), (made("x", "⿱", three, a), "b1 c1 d1 a1 a2"), (made("x", "⿳", eye, a, d), "b1 c1 a1 d2"), (made("x", "⿱", un, a), "b1 b2 c1 c2 a1 a2"),
        (made("x", "⿱", made("y", "⿱", a, eye), d), "a1 a2 b1 d2"), (made("x", "⿰", made("y", "⿱", eye, d), a), "b1 c1 d2 a2"), (made("x", "⿰", made("y", "⿱", a, eye), d), "a1 b1 c2 d2"),
        (made("x", "⿰", made("y", "⿳", a, eye, e), d), "a1 b1 e d2"), (made("x", "⿲", a, b, c), "a1 a2 b1 c1 c2"), (made("x", "⿰", made("y", "⿰", a, e), c), "a1 a2 e c1 c2"), (made("x", "⿰", e, c), "e c1 c2"),
        (made("x", "⿶", a, b), "b1 b2 a1 a2"), (made("x", "⿸", a, b), "a1 a2 b1 b2"),
    ):
        assert run("张码", glyph) == want, want
    assert run("逸码", made("tw", "⿰", a, b)) == "tw 10 20 20 20 20" and run("逸码", made("x", "⿰", a, made("y", "⿱", e, b))) == "a1 a2 s s t"
    stack = made("st", "⿱", b, c)
    for glyph, want in (
        (made("x", "⿰", a, b), "a1 b1 b2"), (made("x", "⿰", a, stack), "a1 b1 c1"), (made("x", "⿲", a, stack, d), "a1 b1 d1"), (made("x", "⿰", a, made("sm", "⿱", b, c)), "sm a1 a2"), (made("x", "⿰", a, made("un", "⿱", b, c)), "a1 un"),
        (made("sm", "⿱", b, c), "sm"), (made("big", "⿱", b, c), "b1 c1 c2"), (made("x", "⿰", e, f), "e f"), (made("刘", "⿰", e, f), "f e"), (made("刘", "⿰", a, b), "a1 b1 b2"), (made("x", "⿰", a, e), "e a1 a2"),
        (made("x", "⿴", e, a), "e a1 a2"), (made("x", "⿴", a, e), "e a1 a2"), (made("x", "⿴", a, b), "b1 a1 a2"), (made("x", "⿻", a, b), "b1 a1 a2"), (made("x", "⿶", a, e, order=[(1, 0), (0, 0)]), "e a1 a2"),
    ):
        assert run("冰雪飞花", glyph) == want, want
    free = analyzers.Settings(mapped={"tw"}, optional={"tw"}, compound_roots={"tw"})
    lists = {k: [Guarded((k,), analyzers.Result(v))] for k, v in roots.items()}
    first_right = analyzers.FirstRight(free, results, lists)
    tell = lambda g: [(list(x.conditions), x.value.roots) for x in first_right.analyse_dynamic(g)]
    assert tell(made("tw", "⿰", a, b)) == [([("present", "tw")], ["tw"]), (["a", "b"], ["a1", "b1"])]
    assert tell(made("x", "⿱", a, b)) == [(["a", "b"], ["a1", "b2"])]


def test_robust_mean_repeats_until_nothing_goes(spark):
    """Each round loses one value of a row of ever farther ones: more rounds than any fixed few."""
    import math

    from glyphmill.operators import timing

    values = [float(k % 7) for k in range(200)] + [10.0 * 4**k for k in range(1, 40)]
    left, rounds = list(values), 0
    while True:
        n, m = len(left), sum(left) / len(left)
        s = math.sqrt(sum((x - m) ** 2 for x in left) / (n - 1))
        stay = [x for x in left if s == 0 or math.erf(abs(x - m) / s / math.sqrt(2)) < 1 - 1 / (2 * n)]
        if len(stay) == n:
            break
        left, rounds = stay, rounds + 1
    assert rounds > 8
    got = timing.robust_mean(spark.createDataFrame([("a", x) for x in values], "k string, v double"), ["k"], "v").first()
    assert (got.n, got.raw) == (len(left), len(values)) and abs(got.value - sum(left) / len(left)) < 1e-9


def test_ranking_rounds_means_of_a_half_alike_in_any_order(spark):
    half = [25.9, 51.08, 55.07, 45.3, 56.5, 3.15]  # 39.5 on average; sums of doubles fall below that from either end
    values = {1: half, 2: half[::-1], 3: [-x for x in half], 4: [None, 1.49], 5: [None], 6: [1e-12, 0.5], 8: [4e7] * 3 + [1.0] * 3}
    rows = [(k, x) for k, xs in values.items() for x in xs]
    for some in (rows, rows[::-1]):
        got = {r.u: (r.n, r["mean"]) for r in timing.user_ranking(spark.createDataFrame(some, "u bigint, v double"), "u", "v").collect()}
        assert got == {1: (6, 40), 2: (6, 40), 3: (6, -40), 4: (2, 1), 5: (1, None), 6: (2, 0), 8: (6, 20000001)}
