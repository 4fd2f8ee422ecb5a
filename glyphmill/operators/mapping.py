"""Mappings of elements to keys: linearisation, merged descendants, inversion, decision spaces.

A mapping row is (element, kind, keys, merge_to): ``str`` has its keys as text,
``merge`` follows another element, ``list`` has positions, which are rows of (element, pos,
key, ref, idx): a literal key, or one key of another element.
Mappings are of a configuration's size; recursion follows references over recursive SQL.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 100


class MappingError(ValueError):
    """A cycle of references, or a reference to nothing."""


def linearise(mapping: DataFrame, positions: DataFrame) -> DataFrame:
    """(element, keys): every arrangement as a string of keys.

    A missing key of a reference is empty; a position that is neither key nor reference counts as ``a``.
    Levels of references are resolved from the bottom up: an element is done when all it refers to is.
    """
    done = mapping.where("kind = 'str'").select("element", "keys")
    open_ = mapping.where("kind <> 'str'").select("element", "kind", "merge_to")
    refs = open_.where("kind = 'merge'").select("element", F.col("merge_to").alias("ref")).unionByName(positions.where("ref IS NOT NULL").select("element", "ref")).distinct()
    missing = refs.join(mapping.select(F.col("element").alias("ref")), "ref", "left_anti").take(1)
    if missing:
        raise MappingError(f"no such element: {missing[0]['ref']}")
    for _ in range(MAX_DEPTH):
        if not open_.take(1):
            return done
        waiting = refs.join(done.select(F.col("element").alias("ref")), "ref", "left_anti").select("element").distinct()
        ready = open_.join(waiting, "element", "left_anti")
        if not ready.take(1):
            raise MappingError("references form a cycle")
        known = done.select(F.col("element").alias("ref"), F.col("keys").alias("ref_keys"))
        merged = ready.where("kind = 'merge'").join(known, F.col("merge_to") == F.col("ref")).select("element", F.col("ref_keys").alias("keys"))
        cell = F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("ref").isNotNull(), F.coalesce(F.expr("substring(ref_keys, idx + 1, 1)"), F.lit(""))).otherwise("a")
        cells = positions.join(ready.where("kind = 'list'").select("element"), "element").join(known, "ref", "left").select("element", "pos", cell.alias("cell"))
        listed = cells.groupBy("element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"]), "").alias("keys"))
        fresh = merged.unionByName(listed)
        # the result is of a configuration's size and read by every later level: cut its lineage
        done = mapping.sparkSession.createDataFrame(done.unionByName(fresh).collect(), "element string, keys string")
        open_ = open_.join(done.select("element"), "element", "left_anti")
    raise MappingError(f"references deeper than {MAX_DEPTH}")


def merged_descendants(spark: SparkSession, mapping: DataFrame) -> DataFrame:
    """(root, element, depth): all elements that merge into a root, over any number of steps."""
    mapping.createOrReplaceTempView("glyphmill_merges")
    return spark.sql("""
        WITH RECURSIVE down (root, element, depth) AS (
          SELECT merge_to, element, 1 FROM glyphmill_merges WHERE kind = 'merge'
          UNION ALL SELECT d.root, m.element, d.depth + 1 FROM down d JOIN glyphmill_merges m ON m.kind = 'merge' AND m.merge_to = d.element WHERE d.depth < 99
        ) SELECT root, element, depth FROM down""")


def inverted(spark: SparkSession, mapping: DataFrame, positions: DataFrame, alphabet: str) -> DataFrame:
    """(key, place, element, depth): elements by their first key, followers right after whom they refer to first; keys without elements have a row without one.

    Merged elements are left out. ``ord`` of the mapping orders siblings.
    """
    first = positions.where("pos = 0").select("element", "key", "ref")
    heads = mapping.where("kind <> 'merge'").join(first, "element", "left").select(
        "element", "ord", F.when(F.col("kind") == "str", F.left("keys", F.lit(1))).otherwise(F.col("key")).alias("key"), F.when(F.col("kind") == "list", F.col("ref")).alias("ref")
    )
    heads.createOrReplaceTempView("glyphmill_heads")
    tree = spark.sql("""
        WITH RECURSIVE tree (element, key, path, depth) AS (
          SELECT element, key, array(ord), 0 FROM glyphmill_heads WHERE ref IS NULL
          UNION ALL SELECT h.element, t.key, concat(t.path, array(h.ord)), t.depth + 1 FROM tree t JOIN glyphmill_heads h ON h.ref = t.element WHERE t.depth < 99
        ) SELECT element, key, path, depth FROM tree""")
    from pyspark.sql import Window

    placed = tree.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("path")))
    keys = spark.createDataFrame([(k,) for k in alphabet], "key string")
    return keys.join(placed.select("key", "place", "element", "depth"), "key", "full")


def potential_length(linear: DataFrame, space_linear: DataFrame) -> DataFrame:
    """(element, length): of the current keys, else of the first arrangement of the space; ``space_linear`` has element, ord, keys."""
    first = space_linear.where("keys IS NOT NULL").groupBy("element").agg(F.min_by("keys", "ord").alias("_first"))
    return linear.join(first, "element", "full").select("element", F.length(F.coalesce("keys", "_first")).alias("length"))


def legal_elements(chars: DataFrame, strokes: int, syllable_elements: DataFrame, custom: DataFrame, structures: str = "⿰⿱⿲⿳⿴⿵⿶⿷⿸⿹⿺⿻⿼⿽⿾⿿") -> DataFrame:
    """(name, kind): the universe of elements; of one name the later kind holds."""
    spark = chars.sparkSession
    fixed = [(str(a), "stroke", 1) for a in range(1, strokes + 1)] + [(f"{a}{b}", "two strokes", 2) for a in range(1, strokes + 1) for b in range(strokes + 1)] + [(c, "structure", 3) for c in structures]
    rows = chars.select("name", F.lit("character").alias("kind"), F.lit(0).alias("k")).unionByName(spark.createDataFrame(fixed, "name string, kind string, k int"))
    rows = rows.unionByName(syllable_elements.select(F.col("element").alias("name"), F.lit("syllable").alias("kind"), F.lit(4).alias("k"))).unionByName(custom.select("name", F.lit("custom").alias("kind"), F.lit(5).alias("k")))
    return rows.groupBy("name").agg(F.max_by("kind", "k").alias("kind"))


def resolve_names(mapping: DataFrame, positions: DataFrame, universe: DataFrame) -> DataFrame:
    """(element, kind of element): unknown names are ``unknown``; an arrangement that refers to an unknown element goes."""
    refs = positions.where("ref IS NOT NULL").select("element", "ref").unionByName(mapping.where("merge_to IS NOT NULL").select("element", F.col("merge_to").alias("ref")))
    bad = refs.join(universe.select(F.col("name").alias("ref")), "ref", "left_anti").select("element").distinct()
    kinds = universe.select(F.col("name").alias("element"), F.col("kind").alias("element_kind"))
    return mapping.join(bad, "element", "left_anti").join(kinds, "element", "left").withColumn("element_kind", F.coalesce("element_kind", F.lit("unknown")))


def join_positions(cells: list) -> list | str:
    """All literal positions make one string."""
    return "".join(cells) if all(isinstance(c, str) for c in cells) else cells


def generate_space(mapping: dict, space: dict, generators: list[dict], variables: dict[str, list[str]]) -> dict[str, list[dict]]:
    """The decision space of a configuration: element -> list of {value, score, condition}.

    An arrangement is None, a string, {"element": name} or a list of cells: a key, {"element", "index"}, {"variable"} or None.
    Current values come first with score 0; generators extend what their pattern matches, keeping existing cells where
    their template has None; variables are replaced by each of their keys; a value that refers to an element requires that it is not null.
    """
    out: dict[str, list[dict]] = {}
    for name in [*mapping, *(n for n in space if n not in mapping)]:
        entries = [{"value": mapping.get(name), "score": 0, "condition": []}] if name in mapping else []
        out[name] = entries + [dict(e) for e in space.get(name, [])]
    for generator in generators:
        pattern = re.compile(generator["regex"])
        for name, entries in out.items():
            if not pattern.search(name):
                continue
            for entry in list(entries):
                value = entry["value"]
                if value is None or isinstance(value, dict):
                    continue
                template, cells = generator["value"], list(value)
                made = []
                for k in range(max(len(cells), len(template))):
                    want = template[k] if k < len(template) else None
                    have = cells[k] if k < len(cells) else None
                    made.append(have if want is None else want if not (isinstance(want, dict) and "variable" in want) or have is None or isinstance(have, str) else have)
                entries.append({"value": join_positions(made), "score": entry["score"] + generator.get("score", 0), "condition": list(entry["condition"])})
            out[name] = _distinct(entries)
    return {name: _with_requirements(_distinct(x for e in entries for x in _expand(e, variables))) for name, entries in out.items()}


def _expand(entry: dict, variables: dict[str, list[str]]) -> list[dict]:
    value = entry["value"]
    if not isinstance(value, list):
        return [entry]
    choices = [variables[c["variable"]] if isinstance(c, dict) and "variable" in c else [c] for c in value]
    return [{**entry, "value": join_positions(list(cells))} for cells in product(*choices)]


def _distinct(entries) -> list[dict]:
    out: list[dict] = []
    for e in entries:
        if not any(e["value"] == x["value"] and e["condition"] == x["condition"] for x in out):
            out.append(e)
    return out


def _with_requirements(entries: list[dict]) -> list[dict]:
    for e in entries:
        value = e["value"]
        names = [value["element"]] if isinstance(value, dict) else [c["element"] for c in value if isinstance(c, dict) and "element" in c] if isinstance(value, list) else []
        e["condition"] = list(e["condition"]) + [c for c in ({"element": n, "op": "is not", "value": None} for n in names) if c not in e["condition"]]
    return entries
