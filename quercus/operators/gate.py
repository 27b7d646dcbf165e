"""The five gate stages, each a function from shared tables to finding rows.

Findings: (artifact_id, stage, code, message, iri, suggested_rewrite).
"""

import copy
from dataclasses import dataclass, field
from functools import cached_property, partial
from threading import RLock
from typing import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import antipattern, is_upper, short_name
from quercus.operators.counts import counts as count_artifacts
from quercus.operators.lint import straddle_pairs
from quercus.operators.ranking import first_per_group
from quercus.operators.rules import rule_edges, unsatisfiable_classes
from quercus.operators.walks import (
    EDGE, Ancestors, ancestors_once, closure, declared_classes, entry_points, grounding_edges, reaches,
)
from quercus.sources.kernel import ANCHOR_IRIS, ANCHORS, KERNEL_NS, Kernel
from quercus.sources.tables import constant_table
from quercus.sources.upper import Upper
from quercus.workspace import Workspace, dealt

# Failure taxonomy: code, description, stage.
TAXONOMY = [
    ("E_NO_AXIOMS", "artifact has no logical axioms", "A"),
    ("E_FLAT", "no subClassOf / no object-property axioms", "A"),
    ("E_NO_BFO", "BFO anchors absent or unpopulated", "A"),
    ("E_BLOATED", "class count exceeds kernel x max_factor", "A"),
    ("E_ANTIPATTERN", "privation/compound class present", "A"),
    ("E_ORPHAN", "class not grounded to BFO", "B"),
    ("E_DISJOINT", "Continuant/Occurrent conflation", "B"),
    ("E_MISTYPED", "node BFO type does not match kernel", "B"),
    ("E_INCONSISTENT", "reasoner inconsistency", "C"),
    ("E_TRIVIAL", "coherent only because vacuous", "C"),
    ("E_COMPETENCY", "SHACL / competency-question violation", "D"),
    ("E_TRIVIALIZED", "input had axioms, output has none", "E"),
    ("E_OVER_RELAXED", "repair removed more than the bound", "E"),
    ("E_PARSE", "artifact could not be parsed", "A"),
]
MAX_FACTOR = 4
#: How many orphans a report shows; the findings hold all of them.
ORPHANS_SHOWN = 50
NORM, DEPENDENT = KERNEL_NS + "Norm", S.UPPER_PREFIX + "0000020"
FINDING = "artifact_id string, stage string, code string, message string, iri string, suggested_rewrite string"
# Fixed value: names of classes that stand for an absence (competency check D4).
D4_NAMES = (
    "(?i)^(AbsenceOf|Absence|LackOf|Lack|Failure|Non[A-Z]|Without|Privation|Deprivation)"
)


def taxonomy(spark) -> DataFrame:
    return constant_table(spark, "code string, description string, stage string", TAXONOMY)


def _row(code, message, when):
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))


def _emit(df: DataFrame, stage: str, rows) -> DataFrame:
    return df.select(
        "artifact_id", F.lit(stage).alias("stage"),
        F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())),
    ).select("artifact_id", "stage", "code", "message", F.lit("").alias("iri"), F.lit("").alias("suggested_rewrite"))


def _finding(df: DataFrame, stage, code, message, iri, rewrite="") -> DataFrame:
    rewrite = F.lit(rewrite) if isinstance(rewrite, str) else rewrite
    return df.select(
        "artifact_id", F.lit(stage).alias("stage"), F.lit(code).alias("code"),
        message.alias("message"), iri.alias("iri"), rewrite.alias("suggested_rewrite"),
    )


class written(cached_property):
    """A table of the inputs, written once: threads that ask while it is written wait for it."""

    def __get__(self, inputs, owner=None):
        if inputs is None:
            return self
        with inputs.locks.setdefault(self.attrname, RLock()):
            return super().__get__(inputs, owner)


@dataclass
class GateInputs:
    """Tables that stages read, each written when a stage first asks for it."""

    triples: DataFrame
    counts: DataFrame
    kernel: Kernel
    upper: Upper
    ws: Workspace
    locks: dict = field(default_factory=dict, repr=False, compare=False)

    @written
    def classes(self) -> DataFrame:
        return self.ws.table(declared_classes(self.triples), "classes")

    @written
    def edges(self) -> DataFrame:
        return self.ws.table(grounding_edges(self.triples, self.kernel), "edges")

    @written
    def entries(self) -> DataFrame:
        found = entry_points(self.edges, self.ws)
        return self.ws.table(found.join(self.classes, ["artifact_id", "cls"], "left_semi"), "entries")

    @written
    def reach(self) -> DataFrame:
        targets = {c for c, _, _ in self.kernel.categories} | {NORM, DEPENDENT}
        return self.ws.table(reaches(self.edges, targets, self.ws), "reach")

    @written
    def unsat(self) -> DataFrame:
        # expressions are read while the edges are still being written
        return self.ws.table(unsatisfiable_classes(self.triples, self.upper, self.ws, lambda: self.edges), "unsat")

    @classmethod
    def of(cls, triples: DataFrame, kernel: Kernel, upper: Upper, ws: Workspace, *names: str) -> "GateInputs":
        """Inputs with the counts written beside the named tables."""
        g = cls(triples, count_artifacts(triples), kernel, upper, ws)
        counts = g.counts
        g.counts = ws.beside(counts=lambda: ws.table(counts, "counts"), others=lambda: g.begin(*names))["counts"]
        return g

    def begin(self, *names: str) -> "GateInputs":
        """Write the named tables and what they rest on side by side, ahead of the stages that read them."""
        self.ws.beside(**{name: partial(getattr, self, name) for name in ("classes", "edges", *names)})
        return self

    def among(self, artifacts: DataFrame) -> "GateInputs":
        """The same inputs for some artifacts only; nothing is walked again."""
        out = copy.copy(self)
        out.__dict__.pop("unsat", None)  # only the artifacts that get so far are reasoned over
        self.begin("entries", "reach")
        for name in ("triples", "counts", "classes", "edges", "entries", "reach"):
            table = getattr(self, name)
            setattr(out, name, table.join(artifacts, "artifact_id", "left_semi").select(table.columns))
        return out

    @property
    def spark(self):
        return self.triples.sparkSession

    @property
    def domain_classes(self):
        return self.classes.where(~is_upper(F.col("cls")))


# -- stage A: smoke test ------------------------------------------------------


def structural_findings(counts: DataFrame, kernel: Kernel, max_factor: int = MAX_FACTOR) -> DataFrame:
    """A1-A3 and A5: read off the counts in one pass."""
    bound = kernel.size * max_factor
    c = F.col
    return _emit(
        counts,
        "A",
        [
            _row("E_NO_AXIOMS", "Artifact has 0 logical axioms (declarations and labels do not count).", c("axioms") <= 0),
            _row("E_FLAT", "No non-trivial rdfs:subClassOf axioms.", c("subClassOf") <= 0),
            _row("E_FLAT", "No owl:ObjectProperty declared.", c("objectProperties") <= 0),
            _row(
                "E_FLAT",
                "Object properties are declared but never used in any axiom or assertion "
                "(declarations alone do not satisfy A3).",
                (c("objectProperties") > 0) & (c("objectPropertyAxioms") <= 0),
            ),
            _row(
                "E_BLOATED",
                F.format_string(
                    f"%d classes exceeds kernel x max_factor ({kernel.size} x {max_factor} = {bound}).", c("classes")
                ),
                (F.lit(kernel.size) > 0) & (c("classes") > bound),
            ),
        ],
    )


def populated_anchors(triples: DataFrame, entries: DataFrame, upper: Upper) -> DataFrame:
    """(artifact_id, anchor): anchors some class path or typed individual populates."""
    by_path = (
        entries.select("artifact_id", F.col("upper_iri").alias("iri"))
        .distinct()
        .join(upper.ancestor_table(entries.sparkSession), "iri")
        .where(F.col("ancestor").isin(ANCHOR_IRIS))
        .select("artifact_id", F.col("ancestor").alias("anchor"))
    )
    by_type = triples.where((F.col("p") == S.TYPE) & F.col("o").isin(ANCHOR_IRIS)).select(
        "artifact_id", F.col("o").alias("anchor")
    )
    return by_path.union(by_type).distinct()


def missing_anchors(artifacts: DataFrame, populated: DataFrame) -> DataFrame:
    """(artifact_id, missing): labels of unpopulated anchors in anchor order; artifacts missing none left out."""
    have = populated.groupBy("artifact_id").agg(F.collect_set("anchor").alias("have"))
    every = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(S.UPPER_PREFIX + i).alias("iri")) for n, i in ANCHORS])
    absent = F.filter(
        every, lambda a: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), a["iri"])
    )
    return (
        artifacts.join(have, "artifact_id", "left")
        .select("artifact_id", F.transform(absent, lambda a: a["label"]).alias("missing"))
        .where(F.size("missing") > 0)
    )


def anchor_findings(missing: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("BFO anchor(s) absent or unpopulated: "), F.array_join("missing", ", "),
        F.lit(". Bare BFO fragment stubs with nothing under them fail A4."),
    )
    return _finding(missing, "A", "E_NO_BFO", text, F.lit(""))


def antipattern_findings(classes: DataFrame, strict: bool = False) -> DataFrame:
    """A6: privation names, then compound names; privation wins."""
    named = classes.select("artifact_id", short_name(F.col("cls")).alias("name")).select(
        "artifact_id", "name", antipattern(F.col("name"), strict).alias("kind")
    )
    privation = F.col("kind") == "privation"
    text = F.when(
        privation,
        F.format_string(
            "'%s' names a privation class. Failure/absence must be a typology instance, not a named class.", "name"
        ),
    ).otherwise(F.format_string("'%s' is a compound class bundling several concepts; decompose it.", "name"))
    rewrite = F.when(
        privation, F.concat(F.lit("instance of a contradiction/failure type, not class "), "name")
    ).otherwise("")
    return _finding(named.where("kind IS NOT NULL"), "A", "E_ANTIPATTERN", text, F.col("name"), rewrite)


def stage_a(g: GateInputs) -> DataFrame:
    populated = populated_anchors(g.triples, g.entries, g.upper)
    missing = missing_anchors(g.counts.select("artifact_id"), populated)
    return (
        structural_findings(g.counts, g.kernel)
        .union(anchor_findings(missing))
        .union(antipattern_findings(g.classes))
    )


# -- stage B: grounding -------------------------------------------------------


def orphans(domain_classes: DataFrame, entries: DataFrame) -> DataFrame:
    return domain_classes.join(entries, ["artifact_id", "cls"], "left_anti")


def orphan_findings(lost: DataFrame) -> DataFrame:
    """A finding per orphan; ``orphan_notes`` says how many a display would leave out."""
    name = short_name(F.col("cls"))
    return _finding(
        lost, "B", "E_ORPHAN",
        F.format_string("'%s' does not reach any BFO upper category via subClassOf*.", name),
        F.col("cls"),
        F.concat(F.lit("add subClassOf to the BFO category that fits "), name),
    )


def orphan_notes(lost: DataFrame, listed: int = ORPHANS_SHOWN) -> DataFrame:
    n = F.count(F.lit(1))
    return lost.groupBy("artifact_id").agg(
        n.alias("orphan_count"), F.greatest(n - listed, F.lit(0)).cast("bigint").alias("orphans_truncated")
    )


def straddle_findings(entries: DataFrame, upper: Upper) -> DataFrame:
    pairs = straddle_pairs(entries.where(~is_upper(F.col("cls"))), upper)
    text = F.format_string(
        "'%s' is under both %s and %s, which are disjoint in BFO 2020.",
        short_name(F.col("cls")), "label_a", "label_b",
    )
    return _finding(pairs, "B", "E_DISJOINT", text, F.col("cls"))


def mistyped(
    reach: DataFrame, domain_classes: DataFrame, entries: DataFrame, kernel: Kernel, upper: Upper
) -> DataFrame:
    """(artifact_id, cls, category_label, required, anchor): classes of a kernel
    category that also reach an anchor disjoint from the category's own."""
    spark = reach.sparkSession
    under = (
        reach.where("cls <> target")
        .join(domain_classes, ["artifact_id", "cls"], "left_semi")
    )
    demands = (
        under.withColumnRenamed("target", "category")
        .join(kernel.category_table(spark), "category")
        .join(upper.clash_sides(spark, ANCHOR_IRIS).withColumnsRenamed({"category": "required", "other": "upper_iri"}), "required")
        .where(F.col("upper_iri").isin(ANCHOR_IRIS))
    )
    return demands.join(entries, ["artifact_id", "cls", "upper_iri"]).select(
        "artifact_id", "cls", "category_label", "required", F.col("upper_iri").alias("anchor")
    )


def mistyped_findings(rows: DataFrame, upper: Upper) -> DataFrame:
    labels = upper.label_table(rows.sparkSession)
    named = rows.join(
        labels.select(F.col("iri").alias("required"), F.col("label").alias("required_label")), "required"
    ).join(labels.select(F.col("iri").alias("anchor"), F.col("label").alias("anchor_label")), "anchor")
    text = F.format_string(
        "'%s' is a %s so must ground to %s, but it also reaches the disjoint %s.",
        short_name(F.col("cls")), "category_label", "required_label", "anchor_label",
    )
    return _finding(named, "B", "E_MISTYPED", text, F.col("cls"))


def stage_b(g: GateInputs) -> DataFrame:
    lost = orphans(g.domain_classes, g.entries)
    out = orphan_findings(lost).union(straddle_findings(g.entries, g.upper))
    if g.kernel.categories:
        rows = mistyped(g.reach, g.domain_classes, g.entries, g.kernel, g.upper)
        out = out.union(mistyped_findings(rows, g.upper))
    return out


# -- stage C: coherence and non-triviality, by rules ----------------------------


def novel_subsumptions(
    entailed: DataFrame, edges: DataFrame, classes: DataFrame, upper: Upper, ws: Workspace
) -> DataFrame:
    """(artifact_id, cls, ancestor): entailed over artifact + kernel + upper, not in the asserted closure."""
    asserted = closure(edges, ws)
    lifted = (
        entailed.withColumnRenamed("ancestor", "iri")
        .where(is_upper(F.col("iri")))
        .join(upper.ancestor_table(edges.sparkSession), "iri")
        .select("artifact_id", "child", "ancestor")
    )
    return (
        entailed.union(lifted)
        .distinct()
        .where((F.col("child") != F.col("ancestor")) & ~F.col("ancestor").endswith("Thing"))
        .join(classes.withColumnRenamed("cls", "child"), ["artifact_id", "child"], "left_semi")
        .join(asserted, ["artifact_id", "child", "ancestor"], "left_anti")
        .withColumnRenamed("child", "cls")
    )


@dataclass
class Novelty:
    """What ``novel_subsumptions`` lists, counted class by class and spelled out for some classes only."""

    entailed: Ancestors  # over artifact, kernel and upper ontology
    asserted: Ancestors
    classes: DataFrame  # artifact_id, child

    def counts(self) -> DataFrame:
        """(artifact_id, cls, n, below): novel ancestors of each class that has some, and those outside the upper ontology."""
        below = [Ancestors(a.facts.where(~is_upper(F.col("ancestor"))), a.members) for a in (self.entailed, self.asserted)]
        parts = [(self.entailed, "n", 1), (self.asserted, "n", -1), (below[0], "below", 1), (below[1], "below", -1)]
        rows = [a.counts().select("artifact_id", "child", *[(F.col("n") * (sign if c == to else 0)).alias(c) for c in ("n", "below")]) for a, to, sign in parts]
        every = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).groupBy("artifact_id", "child").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
        return every.where("n > 0").join(self.classes, ["artifact_id", "child"], "left_semi").withColumnRenamed("child", "cls")

    def of(self, classes: DataFrame) -> DataFrame:
        """(artifact_id, cls, ancestor) of some classes (artifact_id, child)."""
        rows = self.entailed.rows(classes).join(self.asserted.rows(classes), ["artifact_id", "child", "ancestor"], "left_anti")
        return rows.withColumnRenamed("child", "cls")


def novelty(ruled: DataFrame, g: GateInputs) -> Novelty:
    """``novel_subsumptions`` of the edges ``ruled`` by rules, which hold all that are asserted, without spelling them out."""
    done = g.ws.beside(entailed=lambda: ancestors_once(ruled, g.ws), asserted=lambda: ancestors_once(g.edges, g.ws))
    entailed, asserted = done["entailed"], done["asserted"]
    facts = entailed.facts.withColumnRenamed("ancestor", "iri")
    lifted = facts.where(is_upper(F.col("iri"))).join(g.upper.ancestor_table(g.spark), "iri").select("artifact_id", "node", "ancestor")
    told = lambda facts: facts.where(~F.col("ancestor").endswith("Thing"))
    return Novelty(
        Ancestors(g.ws.table(told(entailed.facts.union(lifted).distinct()), "entailed-facts"), entailed.members),
        Ancestors(told(asserted.facts), asserted.members), g.classes.withColumnRenamed("cls", "child"),
    )


def first_novel(news: Novelty, ws: Workspace, classes_shown: int = 5) -> DataFrame:
    """The novel subsumptions of each artifact's first few classes that have any."""
    first = first_per_group(news.counts(), ["artifact_id"], ["cls"], classes_shown, ws)
    return news.of(ws.table(first.select("artifact_id", F.col("cls").alias("child")), "shown"))


def novelty_examples(novel: DataFrame, classes_shown: int = 5, ancestors_shown: int = 3) -> DataFrame:
    """First few classes per artifact with their first few inferred ancestors."""
    per_class = Window.partitionBy("artifact_id", "cls").orderBy("ancestor")
    few = novel.withColumn("rn", F.row_number().over(per_class)).where(F.col("rn") <= ancestors_shown)
    shown = few.groupBy("artifact_id", "cls").agg(F.array_sort(F.collect_set("ancestor")).alias("inferred"))
    per_artifact = Window.partitionBy("artifact_id").orderBy("cls")
    return (
        shown.withColumn("rn", F.row_number().over(per_artifact))
        .where(F.col("rn") <= classes_shown)
        .drop("rn")
    )


def plainly_novel(g: GateInputs) -> DataFrame:
    """(artifact_id): artifacts whose entry points alone show an entailed subsumption that is not asserted.

    Where no upper category is anybody's child in the artifact, a class is asserted to fall under its entry points and
    no other upper category; so any further ancestor of an entry point is news. No closure is needed to see it.
    """
    spark = g.entries.sparkSession
    above = g.upper.ancestor_table(spark).where("iri <> ancestor").select(F.col("iri").alias("upper_iri"), "ancestor")
    onward = g.edges.where(is_upper(F.col("child"))).select("artifact_id").distinct()
    further = g.entries.join(above, "upper_iri").where(~F.col("ancestor").endswith("Thing")).select("artifact_id", "cls", F.col("ancestor").alias("upper_iri"))
    news = further.join(g.entries, ["artifact_id", "cls", "upper_iri"], "left_anti").select("artifact_id").distinct()
    return news.join(onward, "artifact_id", "left_anti")


def stage_c(g: GateInputs) -> DataFrame:
    """Unsatisfiable classes, and artifacts of which nothing follows that they do not say.

    Most artifacts are decided on the second question by ``plainly_novel``; closures are only made of the others.
    """
    unsat = g.begin("unsat", "entries").unsat
    empty = _finding(
        unsat.where(~F.col("cls").endswith("Nothing")), "C", "E_INCONSISTENT",
        F.concat(F.lit("Class is unsatisfiable (equivalent to owl:Nothing): "), "cls"), F.col("cls"),
    )
    path, n = g.ws.write(
        g.counts.select("artifact_id").join(plainly_novel(g), "artifact_id", "left_anti").join(unsat, "artifact_id", "left_anti"), "undecided"
    )
    if n == 0:
        return empty
    open_ = g.spark.read.schema("artifact_id string").parquet(path)
    own = lambda df: df.join(open_, "artifact_id", "left_semi").select(df.columns)
    edges = own(g.edges)
    ruled = g.ws.table(rule_edges(own(g.triples), g.ws, edges).select(*EDGE), "ruled")
    entailed = g.ws.table(closure(ruled, g.ws), "entailed")
    vacuous = open_.join(novel_subsumptions(entailed, edges, own(g.classes), g.upper, g.ws), "artifact_id", "left_anti")
    text = (
        "The artifact is consistent only vacuously: the reasoner entailed no subsumption that was "
        "not already asserted. A coherent-but-empty artifact fails."
    )
    return empty.union(_finding(vacuous, "C", "E_TRIVIAL", F.lit(text), F.lit("")))


# -- stage D: competency checks --------------------------------------------------


@dataclass(frozen=True)
class Competency:
    """A check: rows (artifact_id, offender) are violations.

    ``query`` is a function of the gate inputs, or Spark SQL that reads ``{triples}``
    (the artifact's triples and the kernel's) and ``{subclass_star}`` (artifact_id, child,
    ancestor: reflexive-transitive subclass pairs). Without a column ``offender`` the
    artifact itself is at fault.
    """

    name: str
    code: str
    description: str
    query: Callable | str


def norms_are_dependent(g: GateInputs) -> DataFrame:
    """D1: individuals typed under Norm whose type is not under the dependent-continuant anchor."""
    norm = NORM
    under_norm = g.reach.where(F.col("target") == norm).select("artifact_id", "cls")
    grounded = g.reach.where(F.col("target") == DEPENDENT).select("artifact_id", "cls")
    types = g.triples.where((F.col("p") == S.TYPE) & (F.col("o_kind") == "iri")).select(
        "artifact_id", F.col("s").alias("offender"), F.col("o").alias("cls")
    )
    wrong = under_norm.join(grounded, ["artifact_id", "cls"], "left_anti")
    self_typed = types.where(F.col("cls") == norm).join(grounded, ["artifact_id", "cls"], "left_anti")
    return (
        types.join(wrong, ["artifact_id", "cls"], "left_semi")
        .union(self_typed.select("artifact_id", "cls", "offender"))
        .select("artifact_id", "offender")
        .distinct()
    )


def no_privation_classes(g: GateInputs) -> DataFrame:
    """D4: owl:Class names that stand for an absence, artifact and kernel together."""
    own = g.triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.CLASS) & (F.col("s_kind") == "iri")).select(
        "artifact_id", F.col("s").alias("offender")
    )
    hit = short_name(F.col("offender")).rlike(D4_NAMES)
    kernel = sorted(g.kernel.labels)
    if not kernel:
        return own.where(hit).distinct()
    every = g.counts.select("artifact_id", F.explode(F.array(*map(F.lit, kernel))).alias("offender"))
    return own.union(every).where(hit).distinct()


BUILTIN_CHECKS = [
    Competency(
        "d1_norm_instance", "E_COMPETENCY",
        "D1 - every Norm instance must be a specifically dependent continuant", norms_are_dependent,
    ),
    Competency(
        "d4_no_privation", "E_ANTIPATTERN",
        "D4 - no AbsenceOf*/Lack*/Failure* named class (failure must be an instance)", no_privation_classes,
    ),
]


def kernel_triples(artifacts: DataFrame, kernel: Kernel) -> DataFrame:
    """The kernel's classes and edges as triples of every artifact."""
    rows = [(c, S.TYPE, S.CLASS) for c in sorted(kernel.labels)] + [(c, S.SUBCLASS, p) for c, p in sorted(set(kernel.edges))]
    if not rows:
        return artifacts.sparkSession.createDataFrame([], S.TRIPLES)
    cells = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")) for s, p, o in rows])
    iri, none = F.lit("iri"), F.lit(None).cast("string")
    return artifacts.select("artifact_id", F.inline(cells)).select(
        "artifact_id", "s", iri.alias("s_kind"), "p", "o", iri.alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang")
    )


def _sql_rows(g: GateInputs, query: str) -> DataFrame:
    """Rows of a SQL check; the tables it names get views of their own for this one statement."""
    names = {}
    artifacts = g.counts.select("artifact_id").distinct()
    if "{triples}" in query:
        names["triples"] = g.triples.unionByName(kernel_triples(artifacts, g.kernel))
    if "{subclass_star}" in query:
        nodes = g.edges.select("artifact_id", F.explode(F.array("child", "parent")).alias("child")).union(g.classes)
        loops = nodes.distinct().select("artifact_id", "child", F.col("child").alias("ancestor"))
        names["subclass_star"] = closure(g.edges, g.ws).union(loops).distinct()
    rows = g.spark.sql(query, **names)
    if "offender" not in rows.columns:
        rows = rows.withColumn("offender", F.lit(""))
    return rows


def competency_findings(g: GateInputs, checks=None):
    """(findings, query_errors): a check that fails to analyse or to run is a note, not a pass."""
    out, errors = g.spark.createDataFrame([], FINDING), {}
    for check in BUILTIN_CHECKS if checks is None else checks:
        try:
            rows = check.query(g) if callable(check.query) else _sql_rows(g, check.query)
            rows = rows.select("artifact_id", F.coalesce(F.col("offender").cast("string"), F.lit("")).alias("offender"))
            if checks is not None:  # somebody else's check: what it does at run time is not known before
                rows = g.ws.table(rows, "check")
        except PySparkException as exc:
            errors[check.name] = str(exc)
            continue
        text = F.concat(F.lit((check.description or check.name) + ": "), "offender")
        out = out.union(_finding(rows, "D", check.code, text, F.col("offender")))
    return out, errors


def shape_violations(triples: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """Table-driven constraint shapes.

    ``shapes(target_class, path, min_count, max_count, value_class, datatype, pattern)``
    with nulls for what a shape does not ask; ``types(artifact_id, ind, cls)``.
    Value counts are pre-aggregated per (subject, path) before they meet the shapes.
    """
    rows, key = triples.count(), ["artifact_id", "s", "path"]
    focus = types.join(shapes, F.col("cls") == F.col("target_class")).select(
        "artifact_id", F.col("ind").alias("s"), *shapes.columns
    )
    focus = dealt(focus, rows, *key)
    values = triples.join(shapes.select(F.col("path").alias("p")).distinct(), "p").withColumnRenamed("p", "path")
    values = dealt(values, rows, *key)
    n = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counted = focus.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    card = counted.where("n < min_count OR n > max_count").select(
        "artifact_id", F.col("s").alias("offender"), "path",
        F.when(F.col("n") < F.col("min_count"), "minCount").otherwise("maxCount").alias("constraint"),
    )
    valued = values.join(focus, key)
    literal = valued.where(
        "(datatype IS NOT NULL AND NOT o_datatype <=> datatype) OR NOT o RLIKE pattern"
    ).select(
        "artifact_id", F.col("s").alias("offender"), "path",
        F.when(F.expr("datatype IS NOT NULL AND NOT o_datatype <=> datatype"), "datatype")
        .otherwise("pattern").alias("constraint"),
    )
    member = ["artifact_id", "o", "value_class"]
    classed = (
        dealt(valued.where("value_class IS NOT NULL").select(*key, "o", "value_class"), rows, *member)
        .join(
            dealt(types.select("artifact_id", F.col("ind").alias("o"), F.col("cls").alias("value_class")), rows, *member),
            member, "left_anti",
        )
        .select("artifact_id", F.col("s").alias("offender"), "path", F.lit("class").alias("constraint"))
    )
    return card.union(literal).union(classed).distinct()


# -- stage E: delta invariant ------------------------------------------------------


def delta_findings(
    counts: DataFrame, baseline: DataFrame, removals: DataFrame, properties: bool = True
) -> DataFrame:
    """Compare counts with a baseline, less the logged removals.

    ``properties=False`` leaves the object-property comparison out.

    ``baseline`` has the same columns as ``counts``; ``removals(artifact_id, n_logged,
    n_property)``.  Artifacts without a baseline are not judged.
    """
    base = baseline.select(
        "artifact_id", F.col("axioms").alias("in_axioms"), F.col("objectProperties").alias("in_props")
    )
    zero = F.lit(0).cast("bigint")
    joined = (
        counts.join(base, "artifact_id")
        .join(removals, "artifact_id", "left")
        .withColumns({"n_logged": F.coalesce("n_logged", zero), "n_property": F.coalesce("n_property", zero)})
    )
    c = F.col
    gutted = (c("in_axioms") > 0) & (c("axioms") == 0)
    floor = c("in_axioms") - c("n_logged")
    return _emit(
        joined,
        "E",
        [
            _row(
                "E_TRIVIALIZED",
                F.format_string(
                    "Input had %d axioms; output has 0. This is the destructive-autofix failure (E_TRIVIALIZED).",
                    c("in_axioms"),
                ),
                gutted,
            ),
            _row(
                "E_OVER_RELAXED",
                F.format_string(
                    "Axiom count dropped from %d to %d, more than the %d logged removal(s) account for (floor %d).",
                    c("in_axioms"), c("axioms"), c("n_logged"), floor,
                ),
                ~gutted & (c("axioms") < floor),
            ),
            _row(
                "E_OVER_RELAXED",
                F.format_string(
                    "Object properties dropped from %d to %d with only %d logged.",
                    c("in_props"), c("objectProperties"), c("n_property"),
                ),
                F.lit(properties) & ~gutted & (c("objectProperties") < c("in_props") - c("n_property")),
            ),
        ],
    )
