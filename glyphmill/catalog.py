"""All queries of the engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from glyphmill.queries import domain, extras, statistics, structures

FAMILIES = [statistics, structures, domain, extras]


def FLAGSHIP(spark, sf_dir):
    return queries()["code_collisions"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
