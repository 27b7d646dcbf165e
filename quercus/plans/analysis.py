"""One analysis row per artifact: profile, lint, entailment and status together."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.operators.lint import lint_findings
from quercus.operators.normal_forms import normal_forms
from quercus.operators.profile import profile
from quercus.operators.repair import delta_guard, quarantine, straddle_edges, without_edges
from quercus.operators.rules import (
    coherence, inconsistent_individuals, inferred_subsumptions, justified, rule_edges, unsatisfiable_classes,
)
from quercus.operators.walks import EDGE, closure, entry_points, subclass_edges
from quercus.sources.upper import Upper
from quercus.workspace import Workspace


@dataclass
class Analysis:
    rows: DataFrame
    findings: DataFrame
    unsatisfiable: DataFrame
    inferred: DataFrame


def analyse(triples: DataFrame, upper: Upper, ws: Workspace) -> Analysis:
    """Lists that grow with an artifact stay in their own tables next to ``rows``."""

    def entailed():
        ruled = ws.table(rule_edges(triples, ws).select(*EDGE), "ruled")
        hierarchy = ws.table(closure(ruled, ws), "hierarchy")
        return ws.table(inferred_subsumptions(triples, ws, hierarchy), "inferred")

    # none of these rests on another but by the normal forms; each is a row of small jobs
    forms = normal_forms(triples, ws)
    done = ws.beside(
        findings=lambda: ws.table(lint_findings(entry_points(subclass_edges(triples), ws), upper), "findings"),
        inferred=entailed,
        unsat=lambda: ws.table(unsatisfiable_classes(triples, upper, ws, forms=forms), "unsat"),
        bad=lambda: inconsistent_individuals(triples, upper, ws, forms),
    )
    findings, inferred, unsat, bad = (done[k] for k in ("findings", "inferred", "unsat", "bad"))
    status = coherence(triples.select("artifact_id").distinct(), unsat, bad)
    rows = profile(triples).join(status, "artifact_id")
    zero = F.lit(0).cast("bigint")
    for df, name in ((findings, "lint_findings"), (inferred, "inferred_axioms")):
        n = df.groupBy("artifact_id").agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(n, "artifact_id", "left").withColumn(name, F.coalesce(name, zero))
    return Analysis(rows, findings, justified(unsat, findings), inferred)


@dataclass
class Published:
    lineage: DataFrame  # parent_id, artifact_id (null where refused), removed, refused (why, else null)
    triples: DataFrame  # the new versions only
    analysis: Analysis  # of the new versions only


#: What the id of a fixed version ends in.
FIXED = ".autofixed"


def publish_fixes(triples: DataFrame, findings: DataFrame, upper: Upper, ws: Workspace) -> Published:
    """Fix every straddle that an own edge causes, publish each changed artifact as a new version, and analyse those anew.

    Artifacts without a removable edge get no version and are not read again. A fix that would lose more axioms than it
    logs is refused. Nothing of an old analysis is carried over, so whatever rested on a removed edge is gone.
    """
    removed = ws.table(straddle_edges(findings, triples), "removed")
    changed = ws.table(removed.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("removed")), "changed")
    before = triples.join(changed, "artifact_id", "left_semi").select(triples.columns)
    after = ws.table(without_edges(before, removed), "after")
    refused = delta_guard(before, after, quarantine(removed)).groupBy("artifact_id").agg(F.min("message").alias("refused"))
    lineage = ws.table(
        changed.join(refused, "artifact_id", "left").select(
            F.col("artifact_id").alias("parent_id"),
            F.when(F.col("refused").isNull(), F.concat("artifact_id", F.lit(FIXED))).alias("artifact_id"), "removed", "refused",
        ),
        "lineage",
    )
    going = lineage.where("refused IS NULL").select(F.col("parent_id").alias("artifact_id"), F.col("artifact_id").alias("version"))
    fixed = after.join(going, "artifact_id").withColumn("artifact_id", F.col("version")).select(triples.columns)
    fixed = ws.table(fixed, "versions")
    return Published(lineage, fixed, analyse(fixed, upper, ws))
