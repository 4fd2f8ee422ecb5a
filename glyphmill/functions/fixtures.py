"""Small inline tables that Spark and a SQL oracle read from one literal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    """Rows with a schema of simple types (``name type, ...``)."""

    schema: str
    rows: tuple[tuple, ...]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        """A SELECT over VALUES with the columns cast to their types."""
        names = ", ".join(f"c{k}" for k in range(len(self.columns)))
        casts = ", ".join(f"CAST(c{k} AS {_SQL_TYPES[kind]}) AS {name}" for k, (name, kind) in enumerate(self.columns))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"SELECT {casts} FROM (VALUES {values}) AS v({names})"
