"""Repair: drop straddling subclass edges, within a budget and with a full log."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import is_upper, short_name
from quercus.operators.counts import counts as count_artifacts
from quercus.operators.gate import delta_findings
from quercus.operators.lint import straddle_lint
from quercus.operators.ranking import grouped_rank
from quercus.operators.walks import subclass_edges
from quercus.sources.upper import Upper
from quercus.workspace import Workspace

# Reasons and defaults of the repair report.
NOT_UPPER = "Refusing to drop a non-BFO superclass edge"
NOT_THERE = (
    "The subClassOf edge to remove was not found; the ontology may have changed since it was analyzed"
)
NOTHING_FOUND = "no minimally-relaxable straddle edge found; nothing removed (no silent deletion)"
MAX_REMOVED = 0.02
EDGE_KEY = ["artifact_id", "cls", "drop_iri"]


def direct_edges(triples: DataFrame) -> DataFrame:
    return subclass_edges(triples).toDF(*EDGE_KEY)


def without_edges(triples: DataFrame, removed: DataFrame) -> DataFrame:
    """``triples`` less the (artifact_id, cls, drop_iri) subclass edges."""
    gone = removed.select(
        "artifact_id", F.col("cls").alias("s"), F.lit(S.SUBCLASS).alias("p"), F.col("drop_iri").alias("o")
    ).distinct()
    edges = triples.where(F.col("p") == S.SUBCLASS)
    return triples.where(F.col("p") != S.SUBCLASS).union(
        edges.join(gone, ["artifact_id", "s", "p", "o"], "left_anti").select(triples.columns)
    )


def judge_requests(requests: DataFrame, triples: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Outcome per requested drop (artifact_id, cls, drop_iri): accepted, or why not.

    With ``findings``, only pairs that a stored finding names may be dropped.
    """
    here = direct_edges(triples).withColumn("present", F.lit(True))
    out = requests.join(here, EDGE_KEY, "left")
    known = F.lit(True)
    if findings is not None:
        sides = findings.select(
            "artifact_id", F.col("class_iri").alias("cls"),
            F.explode(F.array("category_a_iri", "category_b_iri")).alias("drop_iri"),
        ).distinct()
        out = out.join(sides.withColumn("flagged", F.lit(True)), EDGE_KEY, "left")
        known = F.coalesce("flagged", F.lit(False))
    reason = (
        F.when(~is_upper(F.col("drop_iri")), NOT_UPPER)
        .when(~known, "No matching straddle finding")
        .when(F.col("present").isNull(), NOT_THERE)
        .otherwise("")
    )
    return out.select(*EDGE_KEY, reason.alias("reason"))


def straddle_edges(findings: DataFrame, triples: DataFrame) -> DataFrame:
    """Every removable straddle edge with the first finding that condemns it."""
    first = findings.groupBy("artifact_id", F.col("class_iri").alias("cls"), "drop_iri").agg(
        F.min(F.struct("category_a_iri", "category_b_iri", "message")).alias("f")
    )
    return first.join(direct_edges(triples), EDGE_KEY, "left_semi").select(
        *EDGE_KEY, "f.category_a_iri", "f.category_b_iri", "f.message"
    )


def fix_all(triples: DataFrame, findings: DataFrame):
    """(fixed triples, removed edges): the more specific category is kept in each straddle."""
    removed = straddle_edges(findings, triples)
    return without_edges(triples, removed), removed


def budgeted_removals(
    triples: DataFrame, findings: DataFrame, counts: DataFrame, ws: Workspace, max_removed: float = MAX_REMOVED
) -> DataFrame:
    """Removals within greatest(1, floor(axioms * ratio)) per artifact, in (class, a, b) order.

    Adds ``bound`` and the artifact's number of findings.
    """
    ranked = grouped_rank(
        straddle_edges(findings, triples), ["artifact_id"],
        ["cls", "category_a_iri", "category_b_iri"], ws,
    )
    bound = F.greatest(F.lit(1), F.floor(F.col("axioms") * F.lit(max_removed))).cast("bigint")
    total = findings.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return (
        ranked.join(counts.select("artifact_id", bound.alias("bound")), "artifact_id")
        .join(total, "artifact_id")
        .where(F.col("rank") <= F.col("bound"))
    )


def quarantine(removals: DataFrame) -> DataFrame:
    """The removal log."""
    return removals.select(
        "artifact_id",
        F.concat(
            F.lit("SubClassOf("), short_name(F.col("cls")), F.lit(" "), short_name(F.col("drop_iri")), F.lit(")")
        ).alias("axiom"),
        F.array("cls", F.lit(S.SUBCLASS), "drop_iri").alias("axiom_iri"),
        F.col("message").alias("justification"),
        F.array("category_a_iri", "category_b_iri").alias("core"),
        F.lit("subclass_edge").alias("kind"),
    )


def logged_removals(log: DataFrame) -> DataFrame:
    return log.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n_logged"),
        F.count_if(F.col("kind") == "object_property").alias("n_property"),
    )


def delta_guard(before: DataFrame, after: DataFrame, log: DataFrame) -> DataFrame:
    """Findings that forbid publishing a fix: the counts-only delta test."""
    return delta_findings(
        count_artifacts(after), count_artifacts(before), logged_removals(log), properties=False
    )


@dataclass
class RepairRun:
    status: DataFrame  # artifact_id, status, error
    quarantine: DataFrame
    triples: DataFrame  # repaired artifacts only


def repair(
    triples: DataFrame, upper: Upper, ws: Workspace, kernel=None, max_removed: float = MAX_REMOVED
) -> RepairRun:
    """Gate, relax within the budget, gate again with the input as baseline.

    An artifact is left alone when stage C did not fail (or did not run) and B saw
    no straddle; one that would exceed its budget is refused whole.
    """
    from quercus.plans.gate import check

    pre = check(triples, kernel=kernel, upper=upper, ws=ws)
    broken = (
        pre.failures().where("code IN ('E_DISJOINT', 'E_INCONSISTENT')").select("artifact_id").distinct()
    )
    broken = ws.table(broken, "broken")
    work = triples.join(broken, "artifact_id", "left_semi").select(triples.columns)
    findings = ws.table(straddle_lint(work, upper, ws), "findings")
    removals = ws.table(budgeted_removals(work, findings, pre.counts, ws, max_removed), "removals")
    spent = removals.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("removed"), F.max("bound").alias("bound"), F.max("n_findings").alias("n_findings")
    )
    over = (F.col("removed") >= F.col("bound")) & (F.col("n_findings") > F.col("removed"))
    plan = ws.table(
        broken.join(spent, "artifact_id", "left").select(
            "artifact_id",
            F.when(F.col("removed").isNull(), NOTHING_FOUND).when(over, "E_OVER_RELAXED").otherwise("").alias("error"),
        ),
        "plan",
    )
    going = plan.where("error = ''").select("artifact_id")
    kept = removals.join(going, "artifact_id", "left_semi")
    fixed = ws.table(
        without_edges(work.join(going, "artifact_id", "left_semi").select(triples.columns), kept), "fixed"
    )
    log = quarantine(removals)
    post = check(
        fixed, kernel=kernel, upper=upper, all_stages=True,
        baseline=pre.counts, removals=logged_removals(quarantine(kept)), ws=ws,
    )
    codes = post.failures().groupBy("artifact_id").agg(
        F.array_join(F.array_sort(F.collect_set("code")), "; ").alias("codes")
    )
    status = (
        pre.counts.select("artifact_id")
        .join(plan, "artifact_id", "left")
        .join(codes, "artifact_id", "left")
        .select(
            "artifact_id",
            F.when(F.col("error").isNull(), "unchanged")
            .when((F.col("error") == "") & F.col("codes").isNull(), "repaired")
            .otherwise("failed")
            .alias("status"),
            F.when(F.col("error") == "", F.col("codes")).otherwise(F.col("error")).alias("error"),
        )
    )
    passed = status.where("status = 'repaired'").select("artifact_id")
    return RepairRun(status, log, fixed.join(passed, "artifact_id", "left_semi").select(triples.columns))
