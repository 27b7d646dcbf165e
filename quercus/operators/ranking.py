"""Ranks that hold up when one group is most of the table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.workspace import Workspace


def grouped_rank(df: DataFrame, group, order, ws: Workspace, name: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by order)`` without one task per group.

    The rows are range-partitioned by (group, order) and written, so the slices are
    fixed; each slice ranks its own rows and adds how many rows of the group lie in
    earlier slices.  A hot group is thereby ranked by as many tasks as it fills.
    """
    sliced = ws.table(
        df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "sliced",
    )
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
        .drop("_slice", "_before")
    )


def first_per_group(df: DataFrame, group, order, limit: int, ws: Workspace) -> DataFrame:
    """First ``limit`` rows per group, whatever the limit: ranked in slices, so a hot group is no single task."""
    return grouped_rank(df, group, order, ws, "rn").where(F.col("rn") <= limit).drop("_n").select(*df.columns, "rn")
