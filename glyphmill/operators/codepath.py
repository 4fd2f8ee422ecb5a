"""Code paths: a configuration's decision graph as one Column expression.

Source nodes ``s*`` emit the key positions of an element, condition nodes ``c*`` branch;
``s0`` is where it starts. A row of glyph analysis has: ``char``; ``sounds`` (map of rule set to
element); ``roots`` (array of names); ``root_strokes`` (array of arrays of stroke classes);
``structure``; ``custom`` (map of name to array of elements); ``special`` (map of name to element).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.codes import signed_element

Pair = tuple[Column, Column]


def find(thing: dict) -> Column:
    """Name of the element an object stands for in a row, or null. A stroke of class 0 is none; a missing second stroke of two is 0."""
    kind = thing["type"]
    if kind == "char":
        return F.col("char")
    if kind == "fixed":
        return F.lit(thing["key"])
    if kind == "sound":
        return F.concat(F.lit(thing["subtype"] + "-"), F.try_element_at("sounds", F.lit(thing["subtype"])))
    if kind == "root":
        return signed_element(F.col("roots"), thing["root"])
    if kind in ("stroke", "two_strokes"):
        strokes = signed_element(F.col("root_strokes"), thing["root"])
        k = thing["stroke"]
        if kind == "stroke":
            return F.nullif(signed_element(strokes, k), F.lit(0)).cast("string")
        sign = (k > 0) - (k < 0)
        first, second = signed_element(strokes, 2 * k - sign), signed_element(strokes, 2 * k)
        return F.when(first.isNotNull(), F.concat(first.cast("string"), F.coalesce(second, F.lit(0)).cast("string")))
    if kind == "structure":
        return F.col("structure")
    if kind == "custom":
        return signed_element(F.try_element_at("custom", F.lit(thing["subtype"])), thing["root"])
    return F.try_element_at("special", F.lit(thing["subtype"]))


def holds(operator: str, element: Column, value: str | None, keys: Column) -> Column:
    """The eight predicates. On a missing element all are false but ``is not`` and ``is absent``; an element without keys matches no code, nor fails to."""
    known = element.isNotNull()
    coded = known & keys.isNotNull()
    return {
        "is": lambda: F.coalesce(element == value, F.lit(False)), "is not": lambda: ~element.eqNullSafe(F.lit(value)),
        "matches": lambda: known & element.rlike(value), "matches not": lambda: known & ~element.rlike(value),
        "code matches": lambda: coded & keys.rlike(value), "code matches not": lambda: coded & ~keys.rlike(value),
        "is present": lambda: known, "is absent": lambda: ~known,
    }[operator]()


def emit(source: dict, lengths: Column) -> Column:
    """Positions (as text) that a source node adds: the literal of a fixed object, one position within the element's length, or all."""
    thing, index = source["object"], source.get("index")
    if thing["type"] == "fixed":
        return F.array(F.lit(thing["key"]))
    element = find(thing)
    length = F.coalesce(F.try_element_at(lengths, element), F.lit(0))
    none = F.array().cast("array<string>")
    if index is None:
        every = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.concat_ws(".", element, i.cast("string")))
        return F.when(element.isNotNull() & (length > 0), every).otherwise(none)
    return F.when(element.isNotNull() & (length > index) & F.lit(index >= 0), F.array(F.concat_ws(".", element, F.lit(str(index))))).otherwise(none)


class CodePathError(ValueError):
    """The graph has a cycle or names a node that it doesn't have."""


def compile_path(sources: dict[str, dict], conditions: dict[str, dict], mapping: dict[str, str], lengths: dict[str, int] | None = None, max_length: int | None = None) -> Column:
    """Array of key positions of a row; ``mapping`` has the linear keys, ``lengths`` those of unmapped elements that may get keys."""
    sizes = {k: len(v) for k, v in mapping.items()} | (lengths or {})
    as_map = lambda d, kind: F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(v))]) if d else F.create_map().cast(kind)
    keys, length_map = as_map(mapping, "map<string,string>"), as_map(sizes, "map<string,int>")

    def walk(node: str | None, seen: tuple[str, ...]) -> Column:
        if not node:
            return F.array().cast("array<string>")
        if node in seen:
            raise CodePathError(" -> ".join((*seen, node)))
        if node.startswith("s"):
            if node not in sources:
                raise CodePathError(node)
            source = sources[node]
            rest = walk(source.get("next"), (*seen, node))
            return rest if node == "s0" else F.concat(emit(source, length_map), rest)
        if node not in conditions:
            raise CodePathError(node)
        c = conditions[node]
        element = find(c["object"])
        test = holds(c["operator"], element, c.get("value"), F.try_element_at(keys, element))
        return F.when(test, walk(c.get("positive"), (*seen, node))).otherwise(walk(c.get("negative"), (*seen, node)))

    path = walk("s0", ())
    return F.slice(path, 1, max_length) if max_length is not None else path


def keys_of(positions: Column, mapping: dict[str, str]) -> Column:
    """The code that positions spell: ``element.index`` by the mapping, others as they are; an element without keys spells nothing."""
    known = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))]) if mapping else F.create_map().cast("map<string,string>")

    def key(p: Column) -> Column:
        element, index = F.regexp_extract(p, r"^(?s:(.*))\.(\d+)$", 1), F.regexp_extract(p, r"\.(\d+)$", 1)
        return F.when(index == "", p).otherwise(F.coalesce(F.substring(F.try_element_at(known, element), F.try_to_number(index, F.lit("999")).cast("int") + 1, F.lit(1)), F.lit("")))

    return F.array_join(F.transform(positions, key), "")
