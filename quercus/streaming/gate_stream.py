"""The gate as a stream: check what arrives, count verdicts, watch for shrinking artifacts."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quercus.plans.gate import check
from quercus.sources.ntriples import artifact_of_file, parse_lines
from quercus.sources.tables import constant_table
from quercus.workspace import Workspace


def arriving_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (artifact_id, file, value) lines of N-Triples files dropped into a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .select(artifact_of_file().alias("artifact_id"), F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), "value")
    )


#: Folders that the manifest of arrived files is dealt to, by artifact.
BUCKETS = 64
MANIFEST = "artifact_id string, file string, bucket int, batch long"


def _arrived(session: SparkSession, manifest: str, batch: DataFrame, batch_id: int):
    """Note the batch's files; return the artifacts that it touches and all of their files so far."""
    bucket = F.pmod(F.xxhash64("artifact_id"), F.lit(BUCKETS)).cast("int")
    files = batch.select("artifact_id", "file").distinct().select("artifact_id", "file", bucket.alias("bucket"), F.lit(batch_id).alias("batch"))
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(manifest)
    # at most a row per file of the batch, then the files of these artifacts
    mine = session.read.schema(MANIFEST).parquet(manifest).where(F.col("batch") == batch_id)
    touched = {r["artifact_id"]: r["bucket"] for r in mine.select("artifact_id", "bucket").distinct().collect()}
    folders = [f"{manifest}/bucket={b}" for b in sorted(set(touched.values()))]
    if not folders:
        return [], []
    names = constant_table(session, "artifact_id string", [(a,) for a in touched])
    known = session.read.schema(MANIFEST).option("basePath", manifest).parquet(*folders)
    return sorted(touched), [r["file"] for r in known.join(names, "artifact_id", "left_semi").select("file").distinct().collect()]


def gate_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 1000, **options):
    """Check the artifacts that files dropped into ``path`` belong to; write reports, findings and dead letters.

    An artifact's files may arrive in several micro-batches. A batch reads all the files so far of the
    artifacts that it touches, which a manifest dealt by artifact names, so the last batch that touches an artifact
    has checked it whole; ``current`` gives the rows of that batch. The drop folder is listed by the stream's source only.

    ``checkpoint`` is the stream's own folder, on storage all executors reach.

    Output folders carry the batch number, so a replayed batch overwrites itself.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        touched, files = _arrived(session, f"{out}/manifest", batch, batch_id)
        if not touched:
            return
        ws = Workspace(session)
        try:
            lines = session.read.text(files).select(artifact_of_file().alias("artifact_id"), "value")
            triples, errors = parse_lines(lines)
            triples = ws.table(triples.distinct(), "arrived")  # parsed once, read by every stage
            gate = check(triples, ws=ws, **options)
            names = constant_table(session, "artifact_id string", [(a,) for a in touched])
            # the artifacts come last: until then their rows of an earlier batch stay current
            for table, df in (("reports", gate.reports()), ("findings", gate.findings), ("errors", errors), ("artifacts", names)):
                df.write.mode("overwrite").parquet(f"{out}/{table}/batch={batch_id}")
        finally:
            ws.remove()  # a batch's tables end with it

    return (
        arriving_lines(spark, path, files_per_batch)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of ``reports``, ``findings`` or ``errors``, each artifact's from the last batch that checked it."""
    last = spark.read.parquet(f"{out}/artifacts").groupBy("artifact_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{table}").join(last, ["artifact_id", "batch"]).drop("batch")


def verdict_windows(verdicts: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Verdict counts per tumbling window of ``ts``; rows later than ``late`` are dropped."""
    return (
        verdicts.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "verdict", "n")
    )


STATE = ", ".join(f"{c} bigint" for c in ("axioms", "objectProperties"))
DELTA = "artifact_id string, version bigint, code string, in_axioms bigint, out_axioms bigint"


def _compare(key, frames, state: GroupState):
    """Each version against the one before it; state is the last counts."""
    rows = pd.concat(frames).sort_values("version")
    last = state.get if state.exists else None
    found = []
    for row in rows.itertuples(index=False):
        now = (int(row.axioms), int(row.objectProperties))
        if last is not None:
            code = None
            if last[0] > 0 and now[0] == 0:
                code = "E_TRIVIALIZED"
            elif now[0] < last[0] - row.n_logged or now[1] < last[1] - row.n_property:
                code = "E_OVER_RELAXED"
            if code:
                found.append((key[0], row.version, code, last[0], now[0]))
        last = now
    state.update(last)
    yield pd.DataFrame(found, columns=["artifact_id", "version", "code", "in_axioms", "out_axioms"])


def delta_stream(versions: DataFrame) -> DataFrame:
    """Delta invariant over successive versions.

    ``versions(artifact_id, version, axioms, objectProperties, n_logged, n_property)``:
    one small row per version, so a group is a handful of rows per micro-batch.
    """
    return versions.groupBy("artifact_id").applyInPandasWithState(
        _compare, DELTA, STATE, "append", GroupStateTimeout.NoTimeout
    )


