"""Where results go."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.sources.ntriples import line_text


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """N-Triples text, one folder per artifact; big artifacts get several files."""
    triples.select("artifact_id", line_text().alias("value")).write.mode(mode).partitionBy(
        "artifact_id"
    ).text(path)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per artifact."""
    reports.write.mode(mode).json(path)


def append_quarantine(log: DataFrame, path: str) -> None:
    note = F.concat_ws(" :: ", "axiom", "justification")
    log.withColumn("note", note).write.mode("append").parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    """Report history, stamped so that lookups can tell newest from oldest."""
    reports.select(
        F.expr("uuid()").alias("report_id"), F.current_timestamp().alias("inserted_at"), *reports.columns
    ).write.mode("append").parquet(path)


def recent_reports(history: DataFrame, show: int | None = None) -> DataFrame:
    """Reports, newest first; ``show`` limits a display."""
    newest = history.orderBy(F.col("inserted_at").desc(), F.col("report_id").desc())
    return newest if show is None else newest.limit(show)


def report_by_id(history: DataFrame, report_id: str) -> DataFrame:
    """One report of the whole history."""
    return history.where(F.col("report_id") == report_id)


def append_analyses(analyses: DataFrame, path: str) -> None:
    analyses.withColumn("analysed_at", F.current_timestamp()).write.mode("append").parquet(path)


def replace_analyses(analyses: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the artifacts at hand."""
    analyses.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "artifact_id"
    ).parquet(path)


def write_theory(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Theory text per artifact, lines in file order within each part file."""
    ordered = lines.repartitionByRange("artifact_id", "section", "sort_key").sortWithinPartitions(
        "artifact_id", "section", "sort_key"
    )
    ordered.select("artifact_id", F.col("line").alias("value")).write.mode(mode).partitionBy("artifact_id").text(path)
