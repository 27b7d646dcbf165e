"""Straddle lint: classes under two categories that the upper ontology keeps apart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.functions.names import is_upper, short_name
from quercus.operators.walks import entry_points, subclass_edges
from quercus.sources.upper import Upper
from quercus.workspace import Workspace

# Wording of the four kinds of straddle (%1$s class, %2$s/%3$s labels).
MESSAGES = {
    "quality_disposition": (
        "%1$s is placed under both Quality and Disposition, which are disjoint. Pick one. "
        "If %1$s is a realizable that the bearer is engineered for, model it as a Disposition "
        "(or Function) and give the measured magnitude a separate Quality."
    ),
    "continuant_occurrent": (
        "%1$s is both a %2$s and a %3$s. Continuant and Occurrent are disjoint. Separate the "
        "continuant aspect from the process or other occurrent it participates in."
    ),
    "material_immaterial": (
        "%1$s is both a %2$s and a %3$s. Material entity and immaterial entity are disjoint. "
        "Decide whether %1$s bears matter or is a boundary, site, or spatial region."
    ),
    "generic": (
        "%1$s is placed under both %2$s and %3$s, which are disjoint in BFO 2020. A single class "
        "cannot be both. Split %1$s into separate classes, one per category, or pick the category "
        "that fits."
    ),
}


def lint_message(name: Column, label_a: Column, label_b: Column, clash_case: Column) -> Column:
    out = None
    for case, text in MESSAGES.items():
        text = F.format_string(text, name, label_a, label_b)
        out = F.when(clash_case == case, text) if out is None else out.when(clash_case == case, text)
    return out


def straddle_pairs(entries: DataFrame, upper: Upper) -> DataFrame:
    """Clashing pairs a < b among each class's entry points.

    One shuffle: the entry points of a class (never more than the upper ontology
    has categories) are gathered by a map-side-combined set, and only classes
    with two or more go on to be asked about.
    """
    gathered = (
        entries.groupBy("artifact_id", "cls")
        .agg(F.collect_set("upper_iri").alias("cats"))
        .where(F.size("cats") > 1)
    )
    paired = gathered.select("artifact_id", "cls", "cats", F.explode("cats").alias("a")).select(
        "artifact_id", "cls", "a", F.explode(F.filter("cats", lambda c: c > F.col("a"))).alias("b")
    )
    return upper.clashing(paired)


def lint_findings(entries: DataFrame, upper: Upper) -> DataFrame:
    """Findings from already computed entry points of the artifact's own edges."""
    name = short_name(F.col("cls"))
    return straddle_pairs(entries.where(~is_upper(F.col("cls"))), upper).select(
        "artifact_id",
        F.col("cls").alias("class_iri"),
        name.alias("class_name"),
        F.col("label_a").alias("category_a"),
        F.col("label_b").alias("category_b"),
        lint_message(name, F.col("label_a"), F.col("label_b"), F.col("clash_case")).alias("message"),
        F.col("a").alias("category_a_iri"),
        F.col("b").alias("category_b_iri"),
        "drop_iri",
    )


def straddle_lint(triples: DataFrame, upper: Upper, ws: Workspace) -> DataFrame:
    return lint_findings(entry_points(subclass_edges(triples), ws), upper)


def derivation_steps(findings: DataFrame) -> DataFrame:
    """Findings as derivation-trace rows; the three facts sit in one array."""
    n, a, b = F.col("class_name"), F.col("category_a"), F.col("category_b")
    return findings.select(
        "artifact_id",
        "class_iri",
        F.lit("Inconsistency").alias("axiom_type"),
        F.lit("BFO Lint").alias("origin"),
        F.lit("High").alias("confidence"),
        F.format_string("%s is placed under both %s and %s, which are disjoint.", n, a, b).alias(
            "description"
        ),
        F.col("message").alias("reason"),
        F.array(
            F.concat(n, F.lit(" transitively subclasses "), a),
            F.concat(n, F.lit(" transitively subclasses "), b),
            F.concat(a, F.lit(" and "), b, F.lit(" are disjoint in BFO 2020")),
        ).alias("supporting_facts"),
    )


def type_clashes(typed: DataFrame, upper: Upper) -> DataFrame:
    """Individuals under clashing categories: ``typed(artifact_id, cls, upper_iri)`` rows."""
    return straddle_pairs(typed, upper)
