"""Analysis history: latest per file, newest lists, counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_file(analyses: DataFrame, file: str = "file_id", by: str = "id") -> DataFrame:
    """The row with the highest id of each file; combined map-side, no sort."""
    rest = [c for c in analyses.columns if c != file]
    best = analyses.groupBy(file).agg(F.max_by(F.struct(*rest), by).alias("row"))
    return best.select(file, *[F.col(f"row.{c}").alias(c) for c in rest])


def newest(df: DataFrame, order: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def newest_first(df: DataFrame, order: str, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(tie).desc())


def analyses_per_file(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("file_id").agg(F.count(F.lit(1)).alias("analyses"))


def user_dashboard(files: DataFrame, analyses: DataFrame, expressions: DataFrame) -> DataFrame:
    """Per user: number of files, analyses and expressions."""
    tagged = [
        df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        for name, df in (("files", files), ("analyses", analyses), ("expressions", expressions))
    ]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    zero = F.lit(0).cast("bigint")
    return every.groupBy("user_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), zero).alias(name)
            for name in ("files", "analyses", "expressions")
        ]
    )


def user_analyses(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analyses with the file they belong to, by the file's owner."""
    return analyses.drop("user_id").join(files.select("file_id", "user_id", "filename"), "file_id")
