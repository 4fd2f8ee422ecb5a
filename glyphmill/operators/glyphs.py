"""Glyph resolution: merging of descriptions, pattern rewriting, rendering, lookup.

Descriptions are rows of a table; merging of sources is relational. Rendering follows
references level by level (``graphs.topological_levels``); the kernels here work on the
descriptions of one level, with what lower levels gave.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.operators.analyzers import Compound
from glyphmill.operators.matching import Component

#: Source tags, by priority.
SOURCES = ("G", "H", "T", "J", "K", "V", "M", "P", "U", "S", "B")


def resolve_sources(descriptions: DataFrame) -> DataFrame:
    """(char, ord, origin, tags, compat) of rows (char, ord, origin, tags): what each description keeps of its source tags.

    ``origin`` is ``user`` or ``system``; a description without tags has all sources. A user description that shares one with an
    earlier one is ``compat``; a system description keeps what none before it has, and goes where nothing is left.
    """
    every = F.array(*map(F.lit, SOURCES))
    own = F.array_distinct(F.filter("tags", lambda t: t.rlike("^[A-Z].*$")))
    rows = descriptions.withColumn("tags", F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) == 0, every).otherwise(own))
    turn = Window.partitionBy("char").orderBy(F.when(F.col("origin") == "user", 0).otherwise(1), "ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.array_distinct(F.flatten(F.collect_list("tags").over(turn)))
    user = F.col("origin") == "user"
    out = rows.withColumn("_before", earlier)
    out = out.withColumn("compat", user & F.arrays_overlap("tags", "_before")).withColumn("tags", F.when(user, F.col("tags")).otherwise(F.array_except("tags", "_before")))
    return out.where(F.size("tags") > 0).select("char", "ord", "origin", "tags", "compat")


def keep_sources(glyphs: DataFrame, wanted: list[str]) -> DataFrame:
    """Glyphs (char, ord, tags) with one of the wanted sources, else the first; numbered from 0."""
    fits = F.arrays_overlap("tags", F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    marked = glyphs.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("char"))).withColumn("_k", F.row_number().over(Window.partitionBy("char").orderBy("ord")))
    kept = marked.where(F.col("_fits") | (~F.col("_any") & (F.col("_k") == 1)))
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("char").orderBy("ord")) - 1).drop("_fits", "_any", "_k")


def match_tag(glyphs: list[Iterable[str]], tag: str) -> list[int]:
    """Glyphs that have a tag, else the one whose sources come first."""
    found = [k for k, tags in enumerate(glyphs) if tag in tags]
    best = lambda tags: min((SOURCES.index(t) for t in tags if t in SOURCES), default=len(SOURCES))
    return found or ([min(range(len(glyphs)), key=lambda k: best(glyphs[k]))] if glyphs else [])


# --- patterns -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A structure over operands: characters, ``Variable`` or other patterns."""

    operator: str
    operands: tuple


@dataclass(frozen=True)
class Variable:
    id: int


def unify(pattern: Pattern, glyph: dict, glyphs_of: dict[str, list[dict]], bound: dict[int, str] | None = None) -> dict[int, str] | None:
    """Bindings of variables to characters under which a compound description fits a pattern, or none.

    A nested pattern may fit any glyph of its operand.
    """
    if glyph.get("type") != "compound" or glyph["operator"] != pattern.operator or len(glyph["operands"]) != len(pattern.operands):
        return None

    def step(k: int, bound: dict[int, str]) -> dict[int, str] | None:
        if k == len(pattern.operands):
            return bound
        want, have = pattern.operands[k], glyph["operands"][k]
        if isinstance(want, Variable):
            return step(k + 1, bound | {want.id: have}) if bound.get(want.id, have) == have else None
        if isinstance(want, Pattern):
            for inner in glyphs_of.get(have, []):
                got = unify(want, inner, glyphs_of, bound)
                if got is not None and (done := step(k + 1, got)) is not None:
                    return done
            return None
        return step(k + 1, bound) if want == have else None

    return step(0, dict(bound or {}))


@dataclass
class Rewriter:
    """Applies transformers (pattern, replacement); new nodes get private characters in a fixed order."""

    glyphs_of: dict[str, list[dict]]
    next_private: int = 0x100000
    made: dict[str, list[dict]] = field(default_factory=dict)

    def build(self, pattern: Pattern, bound: dict[int, str]) -> dict:
        operands = []
        for o in pattern.operands:
            if isinstance(o, Variable):
                if o.id not in bound:
                    raise ValueError(f"variable {o.id} isn't bound")
                operands.append(bound[o.id])
            elif isinstance(o, Pattern):
                name = chr(self.next_private)
                self.next_private += 1
                self.made[name] = [self.build(o, bound)]
                operands.append(name)
            else:
                operands.append(o)
        return {"type": "compound", "operator": pattern.operator, "operands": operands}

    def run(self, transformers: list[tuple[Pattern, Pattern]]) -> dict[str, list[dict]]:
        """Further descriptions by character; those that were there stay."""
        for old, new in transformers:
            for char in sorted(self.glyphs_of):
                for glyph in self.glyphs_of[char]:
                    bound = unify(old, glyph, self.glyphs_of)
                    if bound is not None:
                        self.made.setdefault(char, []).append(self.build(new, bound))
        return self.made


# --- rendering ----------------------------------------------------------------------------------------------


def render(char: str, d: dict, done: dict[str, list[tuple[frozenset, object]]]) -> list[tuple[frozenset, object]]:
    """Glyphs (tags, Component or Compound) of a description; ``done`` has those of characters it refers to.

    A reference to a stroke that isn't there is passed over. Of spliced and compound
    descriptions, alternatives of operands are combined tag by tag.
    """
    tags = frozenset(d.get("tags") or SOURCES)
    kind = d["type"]
    if kind == "basic_component":
        return [(tags, Component(char, d["strokes"]))]
    if kind == "identity":
        return [(tags & t or tags, g if isinstance(g, Compound) else Component(char, g.strokes)) for t, g in _per_tag(done[d["source"]], tags)]
    if kind == "derived_component":
        out = []
        for t, g in _per_tag(done[d["source"]], tags):
            base = strokes_of(g)
            strokes = [base[s["index"]] if s["feature"] == "reference" else s for s in d["strokes"] if s["feature"] != "reference" or 0 <= s["index"] < len(base)]
            out.append((tags & t or tags, Component(char, strokes)))
        return out
    alternatives = [done[o] for o in d["operands"]]
    combos: dict[tuple[int, ...], set] = {}
    for tag in sorted(tags):
        for pick in product(*(match_tag([t for t, _ in a], tag) for a in alternatives)):
            combos.setdefault(pick, set()).add(tag)
    out = []
    for pick, own in combos.items():
        parts = [a[k][1] for a, k in zip(alternatives, pick)]
        compound = Compound(char, d["operator"], parts, [tuple(b) for b in d.get("order") or []])
        compound.gaps = tuple(d.get("gaps") or ())
        out.append((frozenset(own), Component(char, strokes_of(compound)) if kind == "spliced_component" else compound))
    return out


def _per_tag(glyphs, tags):
    """Glyphs of a source that stand for the tags, each once, with the tags it stands for."""
    picked: dict[int, set] = {}
    for tag in sorted(tags):
        for k in match_tag([t for t, _ in glyphs], tag):
            picked.setdefault(k, set()).add(tag)
    return [(frozenset(own), glyphs[k][1]) for k, own in sorted(picked.items())]


def strokes_of(glyph) -> list[dict]:
    """All strokes of a glyph, compounds rendered from the bottom up."""
    if isinstance(glyph, Component):
        return glyph.strokes
    return G.merge(glyph.operator, [strokes_of(p) for p in glyph.parts], glyph.order, getattr(glyph, "gaps", ()))


def resolve(descriptions: dict[str, list[dict]], levels: list[list[str]]) -> dict[str, list[tuple[frozenset, object]]]:
    """All glyphs, level by level. A character without a description is an empty component of the first source."""
    done: dict[str, list[tuple[frozenset, object]]] = {}
    for level in levels:
        for char in level:
            glyphs = [g for d in descriptions.get(char, []) for g in render(char, d, done)]
            done[char] = glyphs or [(frozenset(SOURCES[:1]), Component(char, []))]
    return done


def find_component(glyphs: dict[str, list], key: str):
    """A component by ``char`` or ``char-index``."""
    char, dash, index = key.rpartition("-") if "-" in key[1:] else (key, "", "")
    parts = [g for _, g in glyphs.get(char if dash else key, []) if isinstance(g, Component)]
    k = int(index) if dash and index.isdigit() else 0
    return parts[k] if k < len(parts) else None


def components_to_analyse(glyphs: Iterable[object]) -> dict[str, Component]:
    """The components that glyphs are made of in the end, each once."""
    out: dict[str, Component] = {}
    todo = list(glyphs)
    while todo:
        g = todo.pop()
        if isinstance(g, Component):
            out[g.name] = g
        else:
            todo += g.parts
    return out
