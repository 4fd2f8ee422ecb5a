"""Analyses over tables of glyphs: kernels of matching and analyzers in Arrow batches.

Distinct components are analysed once, spread over tasks by name, with roots and
settings (of a configuration's size) sent along; compounds are then looked up by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.operators import analyzers, matching, selectors
from glyphmill.operators.matching import Component


def strokes_from_json(text: str) -> list[dict]:
    """Strokes of ``[[feature, [x, y], [[command, [params]], ...]], ...]``."""
    return [{"feature": f, "start": tuple(start), "curves": [(c, list(p)) for c, p in curves]} for f, start, curves in json.loads(text)]


def containment(components: DataFrame, roots: dict[str, str], no_cross: bool = False) -> DataFrame:
    """(component, root, mask): all ways roots stand in components (name, strokes as JSON). Roots longer than a component are left out before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Component(n, strokes_from_json(s)) for n, s in roots.items()]
        for batch in batches:
            rows = []
            for name, strokes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = Component(name, strokes_from_json(strokes))
                rows += [(name, r.name, m) for r in known if len(r) <= len(c) for m in matching.contained(c, r, no_cross=no_cross)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["component", "root", "mask"])

    return components.select("name", "strokes").repartition("name").mapInArrow(run, "component string, root string, mask bigint")


def topology(components: DataFrame) -> DataFrame:
    """(component, i, j, relations, oriented): relations of each stroke with the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, strokes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = G.topology(strokes_from_json(strokes))
                rows += [(name, i, j, ";".join(" ".join(map(str, r)) for r in t.matrix[i][j]), (i, j) in t.oriented) for i in range(len(t.matrix)) for j in range(i)]
            cols = [[r[k] for r in rows] for k in range(5)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["component", "i", "j", "relations", "oriented"])

    return components.select("name", "strokes").repartition("name").mapInArrow(run, "component string, i int, j int, relations string, oriented boolean")


def analyse_components(components: DataFrame, roots: dict[str, str], settings: analyzers.Settings, chain: list[str] | None = None, analyzer: str = "默认") -> DataFrame:
    """(component, roots, scheme, n_schemes, scores, error): the best scheme of each component; an error where none uses mapped roots alone."""
    chain = chain or selectors.DEFAULT_CHAIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Component(n, strokes_from_json(s)) for n, s in roots.items()]
        find = analyzers.COMPONENTS[analyzer]
        for batch in batches:
            out = []
            for name, strokes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    a = matching.analyse(Component(name, strokes_from_json(strokes)), known, settings.mapped, settings.optional, chain, selectors.REGISTRY)
                    r = find(a, settings)
                    scores = json.dumps(a.current.scores, ensure_ascii=False)
                    out.append({"component": name, "roots": r.roots, "scheme": "+".join(str(p.mask) for p in a.current.pieces), "n_schemes": len(a.schemes), "scores": scores, "error": None})
                except matching.NoScheme as e:
                    out.append({"component": name, "roots": None, "scheme": None, "n_schemes": 0, "scores": None, "error": f"no scheme for {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("component", pa.string()), ("roots", pa.list_(pa.string())), ("scheme", pa.string()), ("n_schemes", pa.int32()), ("scores", pa.string()), ("error", pa.string())]))

    return components.select("name", "strokes").repartition("name").mapInArrow(run, "component string, roots array<string>, scheme string, n_schemes int, scores string, error string")


def best_schemes(analysed: DataFrame) -> DataFrame:
    return analysed.where("error IS NULL").select("component", F.array_join("roots", " ").alias("roots"), "scheme", "n_schemes")


def component_counts(analysed: DataFrame) -> DataFrame:
    """All components, those that need a split, and those without one."""
    return analysed.agg(F.count("*").alias("total"), F.count_if(F.size("roots") > 1).alias("split"), F.count_if(F.col("error").isNotNull()).alias("failed"))
