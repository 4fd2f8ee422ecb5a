"""Selectors: each scores a scheme by a few numbers, of which smaller are better."""

from __future__ import annotations

from itertools import combinations

from glyphmill.operators.matching import Environment, Scheme

#: Names of roots that frame others; a split of one that stands whole counts against a scheme.
FRAMES = ("口", "囗", "冂", "\ue439", "匚", "凵", "\ue009", "勹", "尸", "\ue407")
#: The default order.
DEFAULT_CHAIN = ["结构完整", "根少优先", "能连不交", "能散不连", "全符笔顺", "取大优先"]


def fewest_roots(s: Scheme, _: Environment) -> list[int]:
    return [len(s.pieces)]


def small_first(s: Scheme, _: Environment) -> list[int]:
    return [len(p.indices) for p in s.pieces]


def big_first(s: Scheme, _: Environment) -> list[int]:
    return [-len(p.indices) for p in s.pieces]


def big_last_first(s: Scheme, _: Environment) -> list[int]:
    return big_first(s, _)[::-1]


def ends_first(s: Scheme, _: Environment) -> list[int]:
    """Sizes of the first, the last, then the others."""
    sizes = big_first(s, _)
    return sizes if len(sizes) < 3 else [sizes[0], sizes[-1], *sizes[1:-1]]


def in_order(s: Scheme, env: Environment) -> list[int]:
    """0 where the pieces, one after the other, are written in order."""
    return [int([i for p in s.pieces for i in p.indices] != list(range(len(env.component))))]


def gaps(s: Scheme, _: Environment) -> list[int]:
    """Pieces whose strokes don't follow each other."""
    return [sum(p.indices[-1] - p.indices[0] + 1 != len(p.indices) for p in s.pieces)]


def merged_roots(s: Scheme, env: Environment) -> list[int]:
    return [sum(r in env.merged for r in s.roots)]


def strong_roots(s: Scheme, env: Environment) -> list[int]:
    return [-sum(r in env.strong for r in s.roots)]


def weak_roots(s: Scheme, env: Environment) -> list[int]:
    return [sum(r in env.weak for r in s.roots)]


def _pairs_with(s: Scheme, env: Environment, kind: str, unless: str | None = None) -> int:
    count = 0
    for a, b in combinations(s.pieces, 2):
        kinds = {r[0] for i in a.indices for j in b.indices for r in env.component.topology.between(i, j)}
        count += kind in kinds and unless not in kinds
    return count


def crossings(s: Scheme, env: Environment) -> list[int]:
    return [_pairs_with(s, env, "cross")]


def touchings(s: Scheme, env: Environment) -> list[int]:
    return [_pairs_with(s, env, "touch", unless="cross")]


def alongside(s: Scheme, env: Environment) -> list[int]:
    """Pairs of pieces between which strokes run alongside."""
    oriented = env.component.topology.oriented
    return [sum(any((max(i, j), min(i, j)) in oriented for i in a.indices for j in b.indices) for a, b in combinations(s.pieces, 2))]


def broken_frames(s: Scheme, env: Environment) -> list[int]:
    return [sum(root in FRAMES and not any(p.mask | mask == p.mask for p in s.pieces) for mask, root in env.masks.items())]


REGISTRY = {
    "根少优先": fewest_roots, "取大优先": big_first, "倒序取大": big_last_first, "首末取大": ends_first, "取小优先": small_first, "全符笔顺": in_order, "连续笔顺": gaps,
    "非形近根": merged_roots, "多强字根": strong_roots, "少弱字根": weak_roots, "能连不交": crossings, "能散不连": touchings, "同向笔画": alongside, "结构完整": broken_frames,
}
