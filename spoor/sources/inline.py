"""Small fixed lookup tables as local relations (their size is known to the planner)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(map(_sql, v))})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    body = ", ".join(f"({', '.join(map(_sql, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
