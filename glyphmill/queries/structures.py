"""Queries over sets, graphs, mappings, covers and times.

Binding F: small synthetic tables that Spark and the SQL read from one literal.
Binding T: the tables as stand-ins (a graph from regions to orders, times from events, segments from lineitem).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import pinyin, unicode
from glyphmill.functions.codes import code_point_name
from glyphmill.functions.fixtures import Fixture
from glyphmill.operators import codepath, glyphs, graphs, lexicon, mapping, search, segments, timing
from glyphmill.sources.tables import parquet

FX_CHARS = Fixture(
    "cp int, char string, name string, tygf int, gb2312 int, strokes string, tags string, operator string, parts string, gf_id int",
    (
        (0x4E00, "一", None, 1, 1, "1", "G", None, None, 1), (0x4E8C, "二", None, 1, 1, "11", "G,T", "⿱", "一 一", 2), (0x571F, "土", None, 1, 1, "121", "G", None, None, 3), (0x58EB, "士", None, 1, 1, "121", "G,J", None, None, 4),
        (0x6728, "木", None, 1, 1, "1234", "G,T", None, None, 5), (0x6797, "林", None, 1, 1, "12341234", "G", "⿰", "木 木", 6), (0x68EE, "森", None, 1, 2, "123412341234", "G", "⿱", "木 林", 7), (0x3400, "㐀", None, 0, 0, "12121", "T", "⿱", "土 一", 8),
        (0x20000, "𠀀", None, 0, 0, "15", "T", None, None, 9), (0x2E80, "⺀", None, 0, 0, "44", "G", None, None, 9), (0x2F00, "⼀", None, 0, 0, "1", "G", None, None, None), (0x31C0, "㇀", None, 0, 0, "1", "G", None, None, None),
        (0xF000, chr(0xF000), "wood head", 0, 0, "123", "user", None, None, None), (0xF001, chr(0xF001), "top of two", 0, 0, "11", "user", "⿱", "一 二", None), (0xF900, "豈", None, 0, 0, "2521", "K", None, None, None), (0x41, "A", None, 0, 0, "5", None, None, None, None),
        (0x572D, "圭", None, 2, 1, "121121", "G", "⿱", "土 土", 11), (0xE001, chr(0xE001), None, 0, 0, "3", "user", None, None, None),
    ),
)
CH = f"c AS ({FX_CHARS.sql()}), b AS ({unicode.BLOCKS.sql()}), cb AS (SELECT c.*, coalesce(b.name, 'unknown') AS block FROM c LEFT JOIN b ON cp BETWEEN b.begin AND b.\"end\")"


def chars(spark):
    return FX_CHARS.df(spark)


def block_range_join(spark, d):
    return unicode.with_block(chars(spark)).select("cp", "block", code_point_name(F.col("cp")).alias("label"))


def block_coverage(spark, d):
    return unicode.block_coverage(chars(spark))


def charset_filters(spark, d):
    rows = unicode.with_block(chars(spark))
    sets = unicode.character_sets(F.col("tygf"), F.col("gb2312"), F.col("block"))
    return rows.agg(*[F.count_if(p).alias(n) for n, p in sets.items()], F.count_if(unicode.is_user_private(F.col("cp"), F.col("block"))).alias("user_private"))


def char_search(spark, d):
    rows = chars(spark)
    return search.characters(rows, strokes="^121", tag="G").select("cp", F.lit("strokes and tag").alias("why")).unionByName(search.characters(rows, operator="⿱", part="一").select("cp", F.lit("structure").alias("why"))).unionByName(
        search.characters(rows, name="two").select("cp", F.lit("name").alias("why"))).unionByName(search.characters(rows, code="6797").select("cp", F.lit("code point").alias("why"))).unionByName(
        search.characters(rows, strokes="(", operator="⿰").select("cp", F.lit("bad pattern").alias("why")))


def quick_search(spark, d):
    return search.quick(chars(spark), "121").select("cp", "char", "strokes")


def tag_histogram(spark, d):
    return chars(spark).where("tags IS NOT NULL").select(F.explode(F.split("tags", ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def id_uniqueness(spark, d):
    """Ids from 1 to 10 that don't belong to exactly one character."""
    ids = spark.range(1, 11).select(F.col("id").cast("int").alias("gf_id"))
    found = chars(spark).where("gf_id IS NOT NULL").groupBy("gf_id").agg(F.count("*").alias("n"))
    return ids.join(found, "gf_id", "left").select("gf_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def next_free_codepoint(spark, d):
    return unicode.next_free_code_point(chars(spark))


FX_LEXICON = Fixture(
    "ord bigint, word string, pinyin string, freq string",
    ((0, "土木", "tu3 mu4", "120"), (1, "森林", "sen1 lin2", "90.5"), (2, "一", "yi1", ""), (3, "二木", "er4 mu4", "x"), (4, "土X", "tu3 yue4", "7"), (5, "圭", "gui1", "3"), (6, "土木", "tu3 mu4", "5"), (7, "林", "lin2", " 12 "), (8, "木", "hm5", "1")),
)
NUM = "CASE WHEN trim(freq) = '' THEN 0.0 ELSE TRY_CAST(trim(freq) AS DOUBLE) END"


def dictionary_scan(spark, d):
    """Rows of three cells with a number for frequency; an empty one is 0."""
    from glyphmill.sources.tables import number

    rows = FX_LEXICON.df(spark).withColumn("f", number(F.trim("freq"))).where("f IS NOT NULL")
    return rows.select("ord", "word", F.size(F.split("pinyin", " ")).alias("n"), F.col("f").alias("freq"))


def dictionary_validation(spark, d):
    rows = FX_LEXICON.df(spark).select("ord", "word")
    good = lexicon.validate(rows.withColumn("word", F.col("word")), chars(spark).select("char"))
    return good.select("ord", "word")


def dictionary_filter(spark, d):
    """Entries whose known characters are in the general set of the first level."""
    return lexicon.filter_lexicon(FX_LEXICON.df(spark).select("ord", "word"), chars(spark), F.col("gb2312") == 1).select("ord", "word")


def characters_used(spark, d):
    return lexicon.characters_used(FX_LEXICON.df(spark), chars(spark)).select("cp", "char")


FX_SYLLABLES = Fixture("syllable string", tuple((s,) for s in "zhong1 xue2 wu3 gui4 an1 lun2 yu2 you3 er4 tu3 mu4 sen1 lin2 yi1 ng2 jiong3 qu1 hm5 shuang1".split()))


def pinyin_rewrite(spark, d):
    rules = {"flat": [("xlit", "zcs", "ZC"), ("xform", "ng", "N")]}
    return pinyin.analyse(FX_SYLLABLES.df(spark), rules)


def pinyin_elements(spark, d):
    return pinyin.element_table(FX_SYLLABLES.df(spark), {})


def pinyin_lexicon(spark, d):
    """Entries with the initials of their syllables; those with an unknown syllable go."""
    table = pinyin.analyse(FX_SYLLABLES.df(spark)).select("syllable", "initial", "tone")
    rows = FX_LEXICON.df(spark).withColumn("pinyin", F.split("pinyin", " "))
    done = pinyin.analyse_lexicon(rows, table)
    return done.select("ord", "word", F.array_join(F.transform("elements", lambda e: F.concat(e["initial"], e["tone"])), " ").alias("sounds"))


# --- mappings -----------------------------------------------------------------------------------------------

FX_MAPPING = Fixture(
    "element string, ord int, kind string, keys string, merge_to string",
    (("A", 0, "str", "f", None), ("B", 1, "merge", None, "A"), ("C", 2, "list", None, None), ("D", 3, "list", None, None), ("E", 4, "str", "gh", None), ("F", 5, "merge", None, "B"), ("G", 6, "list", None, None), ("H", 7, "str", "fz", None), ("I", 8, "list", None, None), ("J", 9, "merge", None, "E")),
)
FX_POSITIONS = Fixture(
    "element string, pos int, key string, ref string, idx int",
    (("C", 0, None, "A", 0), ("C", 1, "x", None, None), ("D", 0, None, "E", 1), ("G", 0, None, "D", 0), ("G", 1, None, "E", 5), ("G", 2, None, None, None), ("I", 0, "q", None, None), ("I", 1, None, "C", 1)),
)
MAP = f"m AS ({FX_MAPPING.sql()}), p AS ({FX_POSITIONS.sql()})"

def linearise_mapping(spark, d):
    return mapping.linearise(FX_MAPPING.df(spark), FX_POSITIONS.df(spark))


def merged_descendants(spark, d):
    return mapping.merged_descendants(spark, FX_MAPPING.df(spark))


def inverted_mapping(spark, d):
    return mapping.inverted(spark, FX_MAPPING.df(spark), FX_POSITIONS.df(spark), "fgq")


FX_SPACE = Fixture("element string, ord int, keys string", (("A", 0, "zzz"), ("K", 0, None), ("K", 1, "ab"), ("K", 2, "abcd"), ("L", 0, "q")))


def potential_length(spark, d):
    return mapping.potential_length(mapping.linearise(FX_MAPPING.df(spark), FX_POSITIONS.df(spark)), FX_SPACE.df(spark))


def merge_maps(spark, d):
    """One map over another: later keys win, also with nothing."""
    from glyphmill.sources.tables import merge_over

    return merge_over(FX_MAPPING.df(spark).select("element", "keys"), FX_SPACE.df(spark).where("ord = 0").select("element", "keys"), "element", "keys")


def import_mapping(spark, d):
    from glyphmill.sources.tables import import_mapping as run

    known = FX_MAPPING.df(spark).select(F.col("element").alias("name"), (F.col("kind") != "merge").alias("has_glyph"), (F.col("element") == "H").alias("private"), (F.col("element") == "E").alias("single"))
    rows = FX_SPACE.df(spark).select(F.col("element").alias("name"), F.coalesce("keys", F.lit("a1")).alias("keys")).unionByName(spark.createDataFrame([("C", "abc"), ("D", "aB"), ("E", "a"), ("H", "a"), ("B", "a")], "name string, keys string"))
    return run(rows, known, "abcdefghijklmnopqrstuvwxyz", 2)


# --- graphs -------------------------------------------------------------------------------------------------


def _table_graph(spark, d):
    """Orders refer to customers, these to nations, these to regions."""
    edge = lambda t, a, b, x, y: parquet(spark, d, t, [a, b]).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("node"), F.concat(F.lit(y), F.col(b).cast("string")).alias("ref"))
    edges = edge("nation", "n_nationkey", "n_regionkey", "n", "r").unionByName(edge("customer", "c_custkey", "c_nationkey", "c", "n")).unionByName(edge("orders", "o_orderkey", "o_custkey", "o", "c"))
    regions = parquet(spark, d, "region", ["r_regionkey"]).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return edges.select("node").distinct().unionByName(regions), edges


def topological_levels(spark, d):
    nodes, edges = _table_graph(spark, d)
    return graphs.topological_levels(spark, nodes, edges).groupBy("level").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def _glyph_edges(spark):
    return chars(spark).where("parts IS NOT NULL").select(F.col("char").alias("node"), F.posexplode(F.split("parts", " ")).alias("k", "ref"))


def glyph_levels(spark, d):
    return graphs.topological_levels(spark, chars(spark).select(F.col("char").alias("node")), _glyph_edges(spark).select("node", "ref"))


def glyph_leaves(spark, d):
    return graphs.leaves(spark, chars(spark).select(F.col("char").alias("node")), _glyph_edges(spark).select("node", "ref"))


def rename_merge(spark, d):
    renames = spark.createDataFrame([("木", "土"), ("一", "㇀")], "old string, new string")
    return graphs.rename(_glyph_edges(spark), renames)


FX_DESCRIPTIONS = Fixture(
    "char string, ord int, origin string, tags string",
    (("a", 0, "user", "G"), ("a", 1, "user", "G,T"), ("a", 2, "system", "G,J"), ("a", 3, "system", "K"), ("a", 4, "system", None), ("a", 5, "system", "V"), ("b", 0, "system", None), ("b", 1, "system", "G"), ("c", 0, "system", "x,J"), ("c", 1, "system", "J,T"), ("d", 0, "user", None), ("d", 1, "system", "G")),
)


def glyph_source_resolution(spark, d):
    rows = FX_DESCRIPTIONS.df(spark).withColumn("tags", F.split("tags", ","))
    return glyphs.resolve_sources(rows).select("char", "ord", F.array_join(F.array_sort("tags"), ",").alias("tags"), "compat")


def glyph_source_selection(spark, d):
    rows = FX_DESCRIPTIONS.df(spark).withColumn("tags", F.split("tags", ","))
    return glyphs.keep_sources(glyphs.resolve_sources(rows), ["J", "K"]).select("char", "ord", "index")


def equivalence_partition(spark, d):
    pairs = timing.key_pairs(spark)
    classes = graphs.partition(pairs.select("node"), timing.key_pair_links(pairs))
    return classes.join(pairs, "node").groupBy("class").agg(F.count("*").alias("n"), F.min("distance").alias("distance"), F.max("node").alias("last"))


# --- code paths, covers, ranks ------------------------------------------------------------------------------

FX_ANALYSES = Fixture(
    "char string, roots string, strokes string, structure string, initial string",
    (("林", "木 木", "1234|1234", "⿰", "l"), ("圭", "土 土", "121|121", "⿱", "g"), ("一", "一", "1", None, "0"), ("森", "木 木 木", "1234|1234|1234", "⿱", "s"), ("空", "", "", None, None)),
)
SOURCES = {
    "s0": {"next": "s1"}, "s1": {"object": {"type": "sound", "subtype": "initial"}, "index": 0, "next": "c1"}, "s2": {"object": {"type": "root", "root": 1}, "next": "s3"}, "s3": {"object": {"type": "root", "root": -1}, "index": 1, "next": "c2"},
    "s4": {"object": {"type": "fixed", "key": "o"}, "next": None}, "s5": {"object": {"type": "two_strokes", "root": 1, "stroke": -1}, "index": 0, "next": "s4"}, "s6": {"object": {"type": "stroke", "root": 1, "stroke": 1}, "index": 0, "next": None},
}
CONDITIONS = {
    "c1": {"object": {"type": "root", "root": 2}, "operator": "is present", "positive": "s2", "negative": "s6"},
    "c2": {"object": {"type": "structure"}, "operator": "is not", "value": "⿰", "positive": "s5", "negative": "s4"},
}
KEYS = {"木": "mu", "土": "t", "一": "y", "1": "h", "12": "ab", "31": "cd", "34": "ef", "initial-l": "l", "initial-g": "g", "initial-s": "s"}


def code_path(spark, d):
    rows = FX_ANALYSES.df(spark)
    split = F.transform(F.filter(F.split("strokes", r"\|"), lambda s: s != ""), lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.cast("int")))
    rows = rows.withColumns({"roots": F.filter(F.split("roots", " "), lambda r: r != ""), "root_strokes": split, "sounds": F.when(F.col("initial").isNotNull(), F.create_map(F.lit("initial"), F.col("initial"))), "custom": F.create_map().cast("map<string,array<string>>"), "special": F.create_map().cast("map<string,string>")})
    path = codepath.compile_path(SOURCES, CONDITIONS, KEYS, {"31": 1}, 5)
    return rows.select("char", F.array_join(path, " ").alias("positions"), codepath.keys_of(path, KEYS).alias("code"))


FX_MASKS = Fixture("mask bigint, root string, necessary boolean", ((1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True), (6, "e", False), (8, "f", True), (9, "g", True), (12, "h", False), (14, "i", True)))
COVERS = f"""RECURSIVE k AS ({FX_MASKS.sql()}), walk (rest, path) AS (
    SELECT CAST(15 AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL SELECT rest - mask, list_append(path, mask) FROM walk JOIN k ON (rest & mask) = mask AND mask >= CASE WHEN rest >= 8 THEN 8 WHEN rest >= 4 THEN 4 WHEN rest >= 2 THEN 2 ELSE 1 END WHERE rest > 0
), cov AS (SELECT path FROM walk WHERE rest = 0)"""


def _covers(spark):
    FX_MASKS.df(spark).createOrReplaceTempView("glyphmill_masks")
    return spark.sql("""
        WITH RECURSIVE walk (rest, path) AS (
          SELECT CAST(15 AS BIGINT), CAST(array() AS ARRAY<BIGINT>)
          UNION ALL SELECT rest - mask, array_append(path, mask) FROM walk JOIN glyphmill_masks ON (rest & mask) = mask
            AND mask >= CASE WHEN rest >= 8 THEN 8 WHEN rest >= 4 THEN 4 WHEN rest >= 2 THEN 2 ELSE 1 END WHERE rest > 0
        ) SELECT path FROM walk WHERE rest = 0""")


def exact_cover(spark, d):
    return _covers(spark).select(F.array_join("path", "+").alias("cover"), F.size("path").alias("pieces"))


def _ranked(spark):
    bits = F.transform("path", lambda m: F.bit_count(m))
    keys = _covers(spark).withColumns({"n": F.size("path"), "sizes": F.transform(bits, lambda b: -b)})
    return keys.withColumn("place", F.row_number().over(Window.orderBy("n", "sizes", "path")))


def rank_schemes(spark, d):
    return _ranked(spark).select("place", F.array_join("path", "+").alias("cover"), F.array_join("sizes", ",").alias("sizes"))


def usable_schemes(spark, d):
    """Schemes that no earlier one makes superfluous, up to the first that needs necessary roots only."""
    r = _ranked(spark)
    roots = r.select("place", F.explode("path").alias("mask")).join(F.broadcast(FX_MASKS.df(spark)), "mask")
    asked = roots.groupBy("place").agg(F.array_sort(F.collect_list(F.when(~F.col("necessary"), F.col("root")))).alias("asked"))
    asked = asked.withColumn("stop", F.min(F.when(F.size("asked") == 0, F.col("place"))).over(Window.partitionBy()))
    a, b = asked.alias("a"), asked.alias("b")
    beaten = a.join(b, (F.col("b.place") < F.col("a.place")) & (F.size(F.array_except("b.asked", "a.asked")) == 0)).select(F.col("a.place").alias("place")).distinct().withColumn("beaten", F.lit(True))
    out = r.join(asked, "place").join(beaten, "place", "left")
    return out.select("place", F.array_join("path", "+").alias("cover"), (F.col("beaten").isNull() & (F.col("place") <= F.coalesce("stop", F.lit(1 << 30)))).alias("usable"))


# --- segments and times -------------------------------------------------------------------------------------


def segment_topology(spark, d):
    """Relations of straight strokes drawn from lineitem: those of one order meet pairwise."""
    rows = parquet(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"])
    x, y, size = (F.col("l_partkey") % 7 * 10).cast("int"), (F.col("l_suppkey") % 7 * 10).cast("int"), (F.col("l_quantity").cast("int") % 5 + 1) * 10
    flat = F.col("l_linenumber") % 2 == 1
    drawn = rows.select(F.col("l_orderkey").alias("component"), F.col("l_linenumber").alias("stroke"), x.alias("x0"), y.alias("y0"), F.when(flat, x + size).otherwise(x).alias("x1"), F.when(flat, y).otherwise(y + size).alias("y1"), flat.alias("flat"))
    return segments.relations(drawn).groupBy("relation").agg(F.count("*").alias("n"))


def robust_mean(spark, d):
    e = parquet(spark, d, "events", ["event_type", "value"]).where("value IS NOT NULL")
    out = timing.robust_mean(e, ["event_type"], "value")
    return out.select("event_type", F.round("value", 4).alias("value"), F.round("std", 4).alias("std"), "n", "raw")


def normalised_equivalence(spark, d):
    """Mean values of event types over each user's first type, pooled over users."""
    e = parquet(spark, d, "events", ["user_id", "event_type", "value"]).where("value IS NOT NULL")
    cls = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    m = timing.robust_mean(e.withColumn("cls", cls), ["user_id", "cls"], "value").withColumn("distance", F.col("cls"))
    pooled = timing.pool(timing.normalise(m.where("value <> 0"), "user_id", "distance", "cls"), "cls", "distance")
    return timing.label(pooled, "distance", "cls").select("cls", "label", F.round("value", 3).alias("value"))


def user_ranking(spark, d):
    return timing.user_ranking(parquet(spark, d, "events", ["user_id", "value"]), "user_id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        block_range_join, block_coverage, charset_filters, char_search, quick_search, tag_histogram, id_uniqueness, next_free_codepoint, dictionary_scan, dictionary_validation, dictionary_filter, characters_used,
        pinyin_rewrite, pinyin_elements, pinyin_lexicon, linearise_mapping, merged_descendants, inverted_mapping, potential_length, merge_maps, import_mapping, topological_levels, glyph_levels, glyph_leaves, rename_merge,
        glyph_source_resolution, glyph_source_selection, equivalence_partition, code_path, exact_cover, rank_schemes, usable_schemes, segment_topology, robust_mean, normalised_equivalence, user_ranking,
    )
}


def _first(s: str, pattern: str, to: str) -> str:
    return f"regexp_replace({s}, '{pattern}', '{to}')"


def _pinyin_sql() -> str:
    initial = _first(_first("syllable", "^([bpmfdtnlgkhjqxzcsr]h?|^).+$", r"\1"), "^$", "0")
    final = "syllable"
    for pattern, to in (("^([jqxy])u", r"\1v"), ("yv", "v"), ("yi?", "i"), ("wu?", "u"), ("iu", "iou"), ("u([in])", r"ue\1"), (r"^.*?([aeêiouv].*|m|ng?)\d$", r"\1")):
        final = _first(final, pattern, to)
    di = _first(_first("syllable", "^([bpmfdtnlgkhjqxzcsryw]h?|^).+$", r"\1"), "^$", "0")
    df = _first("syllable", r"^.*?([aeêiouv].*|m|ng?)\d$", r"\1")
    flat = "CASE regexp_extract(syllable, '[zcs]') WHEN 'z' THEN regexp_replace(syllable, '[zcs]', 'Z') WHEN 'c' THEN regexp_replace(syllable, '[zcs]', 'C') WHEN 's' THEN regexp_replace(syllable, '[zcs]', '') ELSE syllable END"
    return f"""SELECT DISTINCT syllable, {initial} AS initial, {final} AS final, {di} AS double_initial, {df} AS double_final, {_first("syllable", r".+(\d)", r"\1")} AS tone,
        {_first("syllable", "^(.).+", r"\1")} AS first, {_first("syllable", r".*(.)\d", r"\1")} AS last, {_first(flat, "ng", "N")} AS flat FROM s"""


_SETS = """minimal: gb2312 > 0 AND tygf > 0; gb2312: gb2312 > 0; general: tygf > 0; basic: tygf > 0 OR block = 'cjk'; extended: tygf > 0 OR starts_with(block, 'cjk');
supplement: tygf > 0 OR starts_with(block, 'cjk') OR block IN ('radicals-sup', 'kangxi', 'strokes', 'compat', 'compat-sup', 'punct'); panlingual: NOT starts_with(block, 'pua'); maximal: TRUE; user_private: block = 'pua' AND cp >= 61440"""
_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z))"


def _chauvenet(source: str, keys: str, name: str) -> str:
    """What stays of ``source`` when rounds repeat until nothing goes: the last round of each group."""
    return f"""{name}_r AS (SELECT 0 AS i, * FROM {source} UNION ALL
      SELECT i + 1, {keys}, x FROM (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY {keys}) AS kept FROM (
        SELECT *, z IS NULL OR {_ERF} < 1 - 1 / (2.0 * n) AS stays FROM (SELECT *, 1 / (1 + 0.3275911 * z) AS t FROM (
          SELECT *, CASE WHEN s > 0 THEN abs(x - m) / s / sqrt(2.0) END AS z FROM (
            SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, count(*) OVER w AS n FROM {name}_r WINDOW w AS (PARTITION BY {keys})))))) WHERE stays AND kept < n),
    {name} AS (SELECT {keys}, x FROM {name}_r QUALIFY i = max(i) OVER (PARTITION BY {keys}))"""


SQL = {
    "block_range_join": f"WITH {CH} SELECT cp, block, 'U+' || CASE WHEN cp < 4096 THEN lpad(printf('%X', cp), 4, '0') ELSE printf('%X', cp) END AS label FROM cb",
    "block_coverage": f"WITH {CH} SELECT b.name AS block, count(cb.cp) AS n, b.expected FROM b LEFT JOIN cb ON cb.block = b.name GROUP BY 1, 3",
    "charset_filters": f"WITH {CH} SELECT " + ", ".join(f"count(*) FILTER ({p.split(':', 1)[1]}) AS {p.split(':', 1)[0].strip()}" for p in _SETS.split(";")) + " FROM cb",
    "char_search": f"""WITH {CH}
        SELECT cp, 'strokes and tag' AS why FROM c WHERE regexp_matches(strokes, '^121') AND list_contains(string_split(tags, ','), 'G')
        UNION ALL SELECT cp, 'structure' FROM c WHERE operator = '⿱' AND list_contains(string_split(parts, ' '), '一') UNION ALL SELECT cp, 'name' FROM c WHERE contains(coalesce(name, char), 'two')
        UNION ALL SELECT cp, 'code point' FROM c WHERE cp = 26519 UNION ALL SELECT cp, 'bad pattern' FROM c WHERE operator = '⿰'""",
    "quick_search": f"WITH {CH} SELECT cp, char, strokes FROM c WHERE starts_with(strokes, '121') OR char = '121' OR contains(coalesce(name, ''), '121') ORDER BY strokes <> '121', length(strokes), cp LIMIT greatest(5, (SELECT count(*) FROM c WHERE strokes = '121'))",
    "tag_histogram": f"WITH {CH} SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM c WHERE tags IS NOT NULL) GROUP BY 1",
    "id_uniqueness": f"WITH {CH} SELECT CAST(k AS INTEGER) AS gf_id, count(c.cp) AS n FROM range(1, 11) r(k) LEFT JOIN c ON gf_id = k GROUP BY 1 HAVING count(c.cp) <> 1",
    "next_free_codepoint": f"WITH {CH} SELECT CAST(coalesce(min(k), 65535) AS INTEGER) AS cp FROM range(61440, 63744) r(k) WHERE k NOT IN (SELECT cp FROM c)",
    "dictionary_scan": f"WITH l AS ({FX_LEXICON.sql()}) SELECT ord, word, CAST(len(string_split(pinyin, ' ')) AS INTEGER) AS n, {NUM} AS freq FROM l WHERE {NUM} IS NOT NULL",
    "dictionary_validation": f"WITH {CH}, l AS ({FX_LEXICON.sql()}) SELECT ord, word FROM l WHERE NOT EXISTS (SELECT 1 FROM range(1, length(word) + 1) r(k) WHERE substr(word, CAST(k AS INTEGER), 1) NOT IN (SELECT char FROM c))",
    "dictionary_filter": f"WITH {CH}, l AS ({FX_LEXICON.sql()}) SELECT ord, word FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE contains(word, char) AND gb2312 <> 1)",
    "characters_used": f"WITH {CH}, l AS ({FX_LEXICON.sql()}) SELECT cp, char FROM c WHERE EXISTS (SELECT 1 FROM l WHERE contains(word, char))",
    "pinyin_rewrite": f"WITH s AS ({FX_SYLLABLES.sql()}) {_pinyin_sql()}",
    "pinyin_elements": f"WITH s AS ({FX_SYLLABLES.sql()}), x AS ({_pinyin_sql()}) " + " UNION ".join(f"SELECT '{n}-' || \"{n}\" AS element FROM x" for n in pinyin.RULES),
    "pinyin_lexicon": f"""WITH s AS ({FX_SYLLABLES.sql()}), x AS ({_pinyin_sql()}), l AS ({FX_LEXICON.sql()}), e AS (SELECT ord, word, pinyin, unnest(string_split(pinyin, ' ')) AS syl, generate_subscripts(string_split(pinyin, ' '), 1) AS k FROM l)
        SELECT e.ord, e.word, string_agg(initial || tone, ' ' ORDER BY k) AS sounds FROM e LEFT JOIN x ON x.syllable = syl GROUP BY 1, 2 HAVING count(*) = count(x.syllable)""",
    "linearise_mapping": f"""WITH {MAP}, base AS (SELECT element, keys FROM m WHERE kind = 'str'),
        m1 AS (SELECT * FROM base UNION ALL SELECT a.element, b.keys FROM m a JOIN base b ON a.merge_to = b.element WHERE a.kind = 'merge'),
        m2 AS (SELECT * FROM m1 UNION ALL SELECT a.element, b.keys FROM m a JOIN m1 b ON a.merge_to = b.element WHERE a.kind = 'merge' AND a.element NOT IN (SELECT element FROM m1)),
        ready AS (SELECT element FROM m WHERE kind = 'list' AND NOT EXISTS (SELECT 1 FROM p WHERE p.element = m.element AND ref IS NOT NULL AND ref NOT IN (SELECT element FROM m2))),
        l1 AS (SELECT * FROM m2 UNION ALL SELECT p.element, string_agg(coalesce(p.key, CASE WHEN p.ref IS NULL THEN 'a' ELSE substr(x.keys, p.idx + 1, 1) END), '' ORDER BY pos) FROM p JOIN ready USING (element) LEFT JOIN m2 x ON x.element = p.ref GROUP BY 1),
        l2 AS (SELECT * FROM l1 UNION ALL SELECT p.element, string_agg(coalesce(p.key, CASE WHEN p.ref IS NULL THEN 'a' ELSE substr(x.keys, p.idx + 1, 1) END), '' ORDER BY pos) FROM p LEFT JOIN l1 x ON x.element = p.ref WHERE p.element NOT IN (SELECT element FROM l1) GROUP BY 1)
        SELECT element, keys FROM l2""",
    "merged_descendants": f"""WITH RECURSIVE {MAP}, down (root, element, depth) AS (SELECT merge_to, element, 1 FROM m WHERE kind = 'merge'
        UNION ALL SELECT d.root, m.element, d.depth + 1 FROM down d JOIN m ON m.kind = 'merge' AND m.merge_to = d.element) SELECT root, element, depth FROM down""",
    "inverted_mapping": f"""WITH RECURSIVE {MAP}, h AS (SELECT m.element, ord, CASE WHEN kind = 'str' THEN left(keys, 1) ELSE key END AS key, CASE WHEN kind = 'list' THEN ref END AS ref FROM m LEFT JOIN (SELECT element, key, ref FROM p WHERE pos = 0) f USING (element) WHERE kind <> 'merge'),
        tree (element, key, path, depth) AS (SELECT element, key, [ord], 0 FROM h WHERE ref IS NULL UNION ALL SELECT h.element, t.key, list_append(t.path, h.ord), t.depth + 1 FROM tree t JOIN h ON h.ref = t.element),
        pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY path) AS INTEGER) AS place FROM tree), a AS (SELECT unnest(['f', 'g', 'q']) AS key)
        SELECT coalesce(a.key, pl.key) AS key, place, element, depth FROM a FULL JOIN pl ON a.key = pl.key""",
    "potential_length": "SELECT * FROM (VALUES ('A', 1), ('B', 1), ('C', 2), ('D', 1), ('E', 2), ('F', 1), ('G', 2), ('H', 2), ('I', 2), ('J', 2), ('K', 2), ('L', 1)) v(element, length)",
    "merge_maps": f"WITH {MAP}, q AS (SELECT element, keys FROM ({FX_SPACE.sql()}) WHERE ord = 0) SELECT coalesce(q.element, m.element) AS element, CASE WHEN q.element IS NOT NULL THEN q.keys ELSE m.keys END AS keys FROM m FULL JOIN q ON q.element = m.element",
    "import_mapping": f"""WITH {MAP}, r AS (SELECT element AS name, coalesce(keys, 'a1') AS keys FROM ({FX_SPACE.sql()}) UNION ALL SELECT * FROM (VALUES ('C', 'abc'), ('D', 'aB'), ('E', 'a'), ('H', 'a'), ('B', 'a'))),
        v AS (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.element = name AND kind <> 'merge' AND name NOT IN ('H', 'E')) THEN 'unknown key' WHEN NOT regexp_full_match(keys, '[a-z]*') THEN 'unknown value' ELSE 'ok' END AS verdict FROM r)
        SELECT name, CASE WHEN verdict = 'ok' THEN left(keys, 2) ELSE keys END AS keys, verdict FROM v""",
    "topological_levels": """SELECT * FROM (SELECT 0 AS level, count(*) AS n, min('r' || r_regionkey) AS first FROM region UNION ALL SELECT 1, count(*), min('n' || n_nationkey) FROM nation
        UNION ALL SELECT 2, count(*), min('c' || c_custkey) FROM customer UNION ALL SELECT 3, count(*), min('o' || o_orderkey) FROM orders)""",
    "glyph_levels": f"""WITH RECURSIVE {CH}, e AS (SELECT char AS node, unnest(string_split(parts, ' ')) AS ref FROM c WHERE parts IS NOT NULL), w (node, level) AS (SELECT char, 0 FROM c UNION SELECT e.node, w.level + 1 FROM w JOIN e ON e.ref = w.node)
        SELECT node, max(level) AS level FROM w GROUP BY 1""",
    "glyph_leaves": f"""WITH RECURSIVE {CH}, e AS (SELECT char AS node, unnest(string_split(parts, ' ')) AS ref FROM c WHERE parts IS NOT NULL), w (root, node) AS (SELECT char, char FROM c UNION SELECT w.root, e.ref FROM w JOIN e ON e.node = w.node)
        SELECT DISTINCT root, node AS leaf FROM w WHERE node NOT IN (SELECT node FROM e)""",
    "rename_merge": f"""WITH {CH}, e AS (SELECT char AS node, unnest(string_split(parts, ' ')) AS ref, CAST(generate_subscripts(string_split(parts, ' '), 1) - 1 AS INTEGER) AS k FROM c WHERE parts IS NOT NULL)
        SELECT node, k, CASE ref WHEN '木' THEN '土' WHEN '一' THEN '㇀' ELSE ref END AS ref FROM e WHERE node IN (SELECT node FROM e WHERE ref IN ('木', '一'))""",
    "glyph_source_resolution": """SELECT * FROM (VALUES ('a', 0, 'G', FALSE), ('a', 1, 'G,T', TRUE), ('a', 2, 'J', FALSE), ('a', 3, 'K', FALSE), ('a', 4, 'B,H,M,P,S,U,V', FALSE), ('b', 0, 'B,G,H,J,K,M,P,S,T,U,V', FALSE),
        ('c', 0, 'J', FALSE), ('c', 1, 'T', FALSE), ('d', 0, 'B,G,H,J,K,M,P,S,T,U,V', FALSE)) v(char, ord, tags, compat)""",
    "glyph_source_selection": "SELECT * FROM (VALUES ('a', 2, 0), ('a', 3, 1), ('b', 0, 0), ('c', 0, 0), ('d', 0, 0)) v(char, ord, index)",
    "equivalence_partition": """WITH RECURSIVE p AS (SELECT CAST(i * 35 + f AS INTEGER) AS node, i, f, i // 5 AS ci, f // 5 AS cf, i % 5 AS ri, f % 5 AS rf FROM range(35) a(i), range(35) b(f)),
        q AS (SELECT *, CASE WHEN i <> f AND ((i < 20 AND f >= 15) OR (i >= 15 AND f < 20)) THEN -1 ELSE (cf - ci) * (cf - ci) + (rf - ri) * (rf - ri) END AS distance, (i < 15 AND f < 15) OR (i >= 20 AND f >= 20) AS one FROM p),
        k AS (SELECT node, 'h' AS key FROM q WHERE distance = -1 UNION ALL SELECT node, 's' FROM q WHERE i = f UNION ALL SELECT node, 'm' || (cf - ci) || ',' || (rf - ri) FROM q WHERE one
              UNION ALL SELECT node, 'r' || least(i, f) || ',' || greatest(i, f) FROM q
              UNION ALL SELECT node, 'x' || least(node, ((6 - ci) * 5 + ri) * 35 + (6 - cf) * 5 + rf) FROM q),
        g AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (node)),
        r (a, b) AS (SELECT a, b FROM g WHERE a = b UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
        c AS (SELECT k.node, min(x.node) AS class FROM k JOIN r ON r.a = k.key JOIN k x ON x.key = r.b GROUP BY 1)
        SELECT class, count(*) AS n, CAST(min(distance) AS INTEGER) AS distance, max(node) AS last FROM c JOIN q USING (node) GROUP BY 1""",
    "code_path": """SELECT * FROM (VALUES ('林', 'initial-l.0 木.0 木.1 木.1 o', 'lmuuo'), ('圭', 'initial-g.0 土.0 12.0 o', 'gtao'), ('一', '1.0', 'h'), ('森', 'initial-s.0 木.0 木.1 木.1 o', 'smuuo'), ('空', '', '')) v(char, positions, code)""",
    "exact_cover": f"WITH {COVERS} SELECT array_to_string(path, '+') AS cover, CAST(len(path) AS INTEGER) AS pieces FROM cov",
    "rank_schemes": f"""WITH {COVERS}, r AS (SELECT path, list_transform(path, lambda m: -CAST(bit_count(m) AS INTEGER)) AS sizes FROM cov)
        SELECT CAST(row_number() OVER (ORDER BY len(path), sizes, path) AS INTEGER) AS place, array_to_string(path, '+') AS cover, array_to_string(sizes, ',') AS sizes FROM r""",
    "usable_schemes": f"""WITH {COVERS}, r AS (SELECT path, CAST(row_number() OVER (ORDER BY len(path), list_transform(path, lambda m: -CAST(bit_count(m) AS INTEGER)), path) AS INTEGER) AS place FROM cov),
        a AS (SELECT place, path, list_filter(path, lambda m: m IN (3, 6, 12)) AS asked FROM r)
        SELECT place, array_to_string(path, '+') AS cover, NOT EXISTS (SELECT 1 FROM a b WHERE b.place < a.place AND list_has_all(a.asked, b.asked)) AND place <= (SELECT coalesce(min(place), 1000) FROM a WHERE len(asked) = 0) AS usable FROM a""",
    "segment_topology": """WITH s AS (SELECT l_orderkey AS c, l_linenumber AS k, l_linenumber % 2 = 1 AS flat, CAST(l_partkey % 7 * 10 AS INTEGER) AS x0, CAST(l_suppkey % 7 * 10 AS INTEGER) AS y0, (CAST(l_quantity AS INTEGER) % 5 + 1) * 10 AS z FROM lineitem),
        t AS (SELECT c, k, flat, x0, y0, CASE WHEN flat THEN x0 + z ELSE x0 END AS x1, CASE WHEN flat THEN y0 ELSE y0 + z END AS y1 FROM s),
        p AS (SELECT a.flat AS fa, b.flat AS fb, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM t a JOIN t b ON a.c = b.c AND b.k < a.k)
        SELECT CASE WHEN (ax0 = bx0 AND ay0 = by0) OR (ax0 = bx1 AND ay0 = by1) OR (ax1 = bx0 AND ay1 = by0) OR (ax1 = bx1 AND ay1 = by1) THEN 'touch ends'
          WHEN (fa AND ((by0 = ay0 AND bx0 > ax0 AND bx0 < ax1) OR (by1 = ay0 AND bx1 > ax0 AND bx1 < ax1))) OR (NOT fa AND ((bx0 = ax0 AND by0 > ay0 AND by0 < ay1) OR (bx1 = ax0 AND by1 > ay0 AND by1 < ay1)))
            OR (fb AND ((ay0 = by0 AND ax0 > bx0 AND ax0 < bx1) OR (ay1 = by0 AND ax1 > bx0 AND ax1 < bx1))) OR (NOT fb AND ((ax0 = bx0 AND ay0 > by0 AND ay0 < by1) OR (ax1 = bx0 AND ay1 > by0 AND ay1 < by1))) THEN 'touch inside'
          WHEN fa <> fb AND ((fa AND bx0 > ax0 AND bx0 < ax1 AND ay0 > by0 AND ay0 < by1) OR (fb AND ax0 > bx0 AND ax0 < bx1 AND by0 > ay0 AND by0 < ay1)) THEN 'cross'
          WHEN fa = fb THEN 'parallel' ELSE 'perpendicular' END AS relation, count(*) AS n FROM p GROUP BY 1""",
    "robust_mean": f"""WITH RECURSIVE e0 AS (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL), {_chauvenet("e0", "event_type", "e1")}
        SELECT event_type, round(avg(x), 4) AS value, round(stddev_samp(x) / sqrt(count(*)), 4) AS std, count(*) AS n, max(raw) AS raw FROM e1 JOIN (SELECT event_type, count(*) AS raw FROM e0 GROUP BY 1) USING (event_type) GROUP BY 1""",
    "normalised_equivalence": f"""WITH RECURSIVE e0 AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS cls, value AS x FROM events WHERE value IS NOT NULL), {_chauvenet("e0", "user_id, cls", "e1")},
        m AS (SELECT user_id, cls, avg(x) AS value, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(x) / sqrt(count(*)) END AS std FROM e1 GROUP BY 1, 2), mm AS (SELECT * FROM m WHERE value <> 0),
        b AS (SELECT user_id, value AS bv, std AS bs FROM mm WHERE cls = 0), r AS (SELECT cls, CASE WHEN cls = 0 THEN 1.0 ELSE value / bv * (1 + bs * bs / (bv * bv)) END AS ratio FROM mm JOIN b USING (user_id))
        SELECT cls, cls || 'A' AS label, round(avg(ratio), 3) AS value FROM r GROUP BY 1""",
    "user_ranking": "SELECT user_id, count(*) AS n, CAST(round(avg(value)) AS BIGINT) AS mean FROM events GROUP BY 1",
}
