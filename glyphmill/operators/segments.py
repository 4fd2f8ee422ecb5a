"""Relations of straight strokes, in SQL alone: what needs no curve needs no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relations(strokes: DataFrame) -> DataFrame:
    """(component, a, b, relation) for each stroke and each earlier one of its component.

    ``strokes`` has component, stroke, x0, y0, x1, y1 and flat. Common ends come before ends on the other's inside, then crossing, then how they
    stand. A component is a few strokes, so the join within it is small however many components there are.
    """
    a, b = strokes.alias("a"), strokes.alias("b")
    c = lambda s, k: F.col(f"{s}.{k}")
    pairs = a.join(b, (c("a", "component") == c("b", "component")) & (c("b", "stroke") < c("a", "stroke")))
    ends = [("x0", "y0"), ("x1", "y1")]
    common = F.lit(False)
    for xa, ya in ends:
        for xb, yb in ends:
            common |= (c("a", xa) == c("b", xb)) & (c("a", ya) == c("b", yb))

    def inside(s: str, t: str):
        """An end of ``t`` strictly within ``s``."""
        out = F.lit(False)
        for x, y in ends:
            dx, dy = (c(s, "x1") - c(s, "x0")), (c(s, "y1") - c(s, "y0"))
            px, py = (c(t, x) - c(s, "x0")), (c(t, y) - c(s, "y0"))
            along = px * dx + py * dy
            out |= (dx * py - dy * px == 0) & (along > 0) & (along < dx * dx + dy * dy)
        return out

    def side(s: str, t: str):
        """Below zero where the ends of ``t`` lie to different sides of ``s``."""
        dx, dy = (c(s, "x1") - c(s, "x0")), (c(s, "y1") - c(s, "y0"))
        of = lambda x, y: dx * (c(t, y) - c(s, "y0")) - dy * (c(t, x) - c(s, "x0"))
        return of(*ends[0]) * of(*ends[1])

    crossing = (side("a", "b") < 0) & (side("b", "a") < 0)
    relation = F.when(common, "touch ends").when(inside("a", "b") | inside("b", "a"), "touch inside").when(crossing, "cross").when(c("a", "flat") == c("b", "flat"), "parallel").otherwise("perpendicular")
    return pairs.select(c("a", "component").alias("component"), c("a", "stroke").alias("a"), c("b", "stroke").alias("b"), relation.alias("relation"))
