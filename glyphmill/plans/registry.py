"""Plug-ins by kind and name: selectors, component and compound analyzers, assemblers, pinyin analyzers."""

from __future__ import annotations

from collections.abc import Callable

from glyphmill.functions import pinyin
from glyphmill.operators import analyzers, assembly, selectors

REGISTRY: dict[str, dict[str, Callable]] = {
    "selector": dict(selectors.REGISTRY),
    "component analyzer": dict(analyzers.COMPONENTS),
    "compound analyzer": dict(analyzers.COMPOUNDS),
    "assembler": {"默认": assembly.default_assembler, "星空键道": assembly.head_rest_assembler},
    "pinyin analyzer": {"默认": pinyin.analyse_lexicon},
}


class UnknownPlugin(KeyError):
    """No plug-in of that name."""


def register(kind: str, name: str, plugin: Callable) -> None:
    REGISTRY[kind][name] = plugin


def get(kind: str, name: str) -> Callable:
    """An unknown selector may be passed over by its caller; any other unknown name is an error."""
    try:
        return REGISTRY[kind][name]
    except KeyError:
        raise UnknownPlugin(f"{kind}: {name}") from None
