"""The gate end to end: stages in order, halting, verdicts and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators.counts import counts as count_artifacts
from quercus.operators.gate import (
    GateInputs, competency_findings, delta_findings, stage_a, stage_b, stage_c,
)
from quercus.sources.kernel import Kernel, builtin_kernel
from quercus.sources.upper import Upper, builtin_upper
from quercus.workspace import Workspace

STAGES = ["A", "B", "C", "D", "E"]
NO_BASELINE = "no baseline supplied (E runs on repair or with --baseline)"


class GateRun:
    """Findings, stage rows and reports of one gate run over a corpus.

    Per-artifact rows stay flat: a report carries counts per failure code, never
    an array that grows with the artifact, and the findings are their own table.
    """

    def __init__(self, counts, findings, stages, kernel_version, errors):
        self.counts, self.findings, self.stages = counts, findings, stages
        self.kernel_version, self.errors = kernel_version, errors

    def failures(self) -> DataFrame:
        """(artifact_id, stage, code, n) of the stages that ran."""
        return self.findings.groupBy("artifact_id", "stage", "code").agg(F.count(F.lit(1)).alias("n"))

    def verdicts(self) -> DataFrame:
        failed = F.bool_or((F.col("skipped") == "") & ~F.col("passed"))
        return self.stages.groupBy("artifact_id").agg(F.when(failed, "fail").otherwise("pass").alias("verdict"))

    def antipattern_hits(self) -> DataFrame:
        hit = (F.col("stage") == "A") & (F.col("code") == "E_ANTIPATTERN")
        return self.findings.where(hit).select("artifact_id", F.col("iri").alias("name"))

    def suggested_rewrites(self) -> DataFrame:
        """(artifact_id, key, rewrite): one per key, the last one in message order."""
        key = F.when(F.col("iri") != "", F.col("iri")).otherwise(F.col("code"))
        return (
            self.findings.where("suggested_rewrite <> ''")
            .groupBy("artifact_id", key.alias("key"))
            .agg(F.max_by("suggested_rewrite", F.struct("stage", "message")).alias("rewrite"))
        )

    def reports(self) -> DataFrame:
        """One row per artifact: verdict, counts, stages map with failure counts."""
        per_code = self.failures()
        failures = per_code.groupBy("artifact_id", "stage").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("failures")
        )
        rows = self.stages.join(failures, ["artifact_id", "stage"], "left")
        stages = rows.groupBy("artifact_id").agg(
            F.map_from_entries(
                F.collect_list(F.struct("stage", F.struct("passed", "skipped", "failures")))
            ).alias("stages")
        )
        return (
            self.counts.select("artifact_id", F.struct(*S.COUNT_COLUMNS).alias("counts"))
            .join(self.verdicts(), "artifact_id")
            .join(stages, "artifact_id")
            .select("artifact_id", F.lit(self.kernel_version).alias("kernel_version"), "verdict", "counts", "stages")
        )

    def exit_status(self) -> int:
        return 0 if self.verdicts().where("verdict = 'fail'").isEmpty() else 1


def halt(artifacts: DataFrame, findings: DataFrame, all_stages: bool, has_baseline: bool):
    """(findings kept, stages): later stages of a failed artifact are masked unless ``all_stages``."""
    per = findings.groupBy("artifact_id").agg(
        F.min("stage").alias("first"),
        *[F.bool_or(F.col("stage") == s).alias(f"bad_{s}") for s in STAGES],
    )
    joined = artifacts.join(per, "artifact_id", "left")
    rows = []
    for s in STAGES:
        halted = F.lit(False) if all_stages else F.coalesce(F.col("first") < s, F.lit(False))
        skipped = F.when(halted, F.concat(F.lit("halted at "), "first")).otherwise("")
        if s == "E" and not has_baseline:
            skipped = F.lit(NO_BASELINE)
        bad = F.coalesce(f"bad_{s}", F.lit(False))
        rows.append(
            F.struct(F.lit(s).alias("stage"), ((skipped != "") | ~bad).alias("passed"), skipped.alias("skipped"))
        )
    stages = joined.select("artifact_id", F.inline(F.array(*rows)))
    kept = findings
    if not all_stages:
        kept = findings.join(
            stages.where("skipped = ''").select("artifact_id", "stage"), ["artifact_id", "stage"], "left_semi"
        ).select(findings.columns)
    return kept, stages


def check(
    triples: DataFrame,
    kernel: Kernel | None = None,
    upper: Upper | None = None,
    all_stages: bool = False,
    baseline: DataFrame | None = None,
    removals: DataFrame | None = None,
    competency=None,
    ws: Workspace | None = None,
) -> GateRun:
    """Run the gate over every artifact of ``triples`` at once."""
    spark = triples.sparkSession
    ws = ws or Workspace(spark)
    kernel, upper = kernel or builtin_kernel(), upper or builtin_upper()
    # with all stages no artifact is left out of the reasoning, so it need not wait for the first stages
    g = GateInputs.of(triples, kernel, upper, ws, "entries", "reach", *(["unsat"] if all_stages else []))
    counts = g.counts
    findings = stage_a(g).union(stage_b(g))
    if not all_stages:
        # The costly stages only see artifacts that got through A and B.
        findings = ws.table(findings, "findings-ab")
        path, n = ws.write(counts.join(findings, "artifact_id", "left_anti").select("artifact_id"), "alive")
        if n == 0:
            kept, stages = halt(counts.select("artifact_id"), findings, all_stages, baseline is not None)
            return GateRun(counts, kept, stages, kernel.version, {})
        g = g.among(spark.read.schema("artifact_id string").parquet(path))
    found, errors = competency_findings(g, competency)
    findings = findings.union(stage_c(g)).union(found)
    if baseline is not None:
        if removals is None:
            removals = spark.createDataFrame([], "artifact_id string, n_logged bigint, n_property bigint")
        findings = findings.union(delta_findings(counts, baseline, removals))
    findings = ws.table(findings, "findings")
    kept, stages = halt(counts.select("artifact_id"), findings, all_stages, baseline is not None)
    return GateRun(counts, kept, stages, kernel.version, errors)


def baseline_for(triples: DataFrame) -> DataFrame:
    return count_artifacts(triples)
