"""Constant rows as local relations: exact statistics, no job to build them."""

from pyspark.sql import DataFrame, SparkSession


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"{v}L"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """``columns`` is a DDL list such as ``"iri string, n bigint"``."""
    fields = [c.strip().split(" ") for c in columns.split(",")]
    casts = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in fields))
    values = ", ".join("(" + ", ".join(_cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
