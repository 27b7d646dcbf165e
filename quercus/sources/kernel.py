"""The kernel: domain categories, each grounded in an anchor of the upper ontology."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import short_name
from quercus.sources.tables import constant_table

KERNEL_NS = "urn:kernel#"

# The seven anchors, in report order.
ANCHORS = [
    ("Continuant", "0000002"),
    ("Occurrent", "0000003"),
    ("SpecificallyDependentContinuant", "0000020"),
    ("RealizableEntity", "0000017"),
    ("Role", "0000023"),
    ("MaterialEntity", "0000040"),
    ("GenericallyDependentContinuant", "0000031"),
]
ANCHOR_IRIS = [S.UPPER_PREFIX + n for _, n in ANCHORS]
# The bundled kernel: class, label, parent (anchor id or kernel class).
KERNEL_CLASSES = [
    ("Norm", "Norm", "0000020"),
    ("Obligation", "Obligation", "0000020"),
    ("LegalEffect", "Legal Effect", "0000020"),
    ("Role", "Role", "0000023"),
    ("Agent", "Agent", "0000040"),
    ("LegalEvent", "Legal Event", "0000003"),
    ("Contradiction", "Contradiction", "0000031"),
    ("NormConflict", "Norm Conflict", "Contradiction"),
    ("RecognitionFailure", "Recognition Failure", "Contradiction"),
    ("EffectBreak", "Effect Break", "Contradiction"),
]
KERNEL_VERSION = "kernel/0.1"
UNVERSIONED = "kernel/unversioned"


@dataclass(frozen=True)
class Kernel:
    """labels: class iri -> label; edges: (child, parent) pairs."""

    labels: dict
    edges: frozenset
    version: str = UNVERSIONED

    @property
    def size(self) -> int:
        return len(self.labels)

    @cached_property
    def categories(self) -> list:
        """(iri, label, required anchor): non-OBO classes right under an anchor."""
        return sorted(
            (c, self.labels[c], p)
            for c, p in self.edges
            if c in self.labels and not c.startswith(S.OBO) and p in ANCHOR_IRIS
        )

    @cached_property
    def contradiction_types(self) -> set:
        """Everything below a class whose label speaks of a contradiction."""
        found = set()
        frontier = {c for c, label in self.labels.items() if "contradiction" in label.lower()}
        while frontier:
            frontier = {c for c, p in self.edges if p in frontier} - found
            found |= frontier
        return found

    @cached_property
    def upward_edges(self) -> list:
        """(start, child, parent): every kernel edge met when walking up from start."""
        out = set()
        for start in {n for e in self.edges for n in e}:
            seen, frontier = set(), {start}
            while frontier:
                seen |= frontier
                step = {(c, p) for c, p in self.edges if c in frontier}
                out |= {(start, c, p) for c, p in step}
                frontier = {p for _, p in step} - seen
        return sorted(out)

    def upward_table(self, spark) -> DataFrame:
        return constant_table(spark, "start string, child string, parent string", self.upward_edges)

    def category_table(self, spark) -> DataFrame:
        return constant_table(
            spark, "category string, category_label string, required string", self.categories
        )


def builtin_kernel() -> Kernel:
    def parent(p):
        return (S.UPPER_PREFIX if p.isdigit() else KERNEL_NS) + p

    return Kernel(
        labels={KERNEL_NS + c: label for c, label, _ in KERNEL_CLASSES},
        edges=frozenset((KERNEL_NS + c, parent(p)) for c, _, p in KERNEL_CLASSES),
        version=KERNEL_VERSION,
    )


@dataclass(frozen=True)
class StoredKernel:
    """A kernel of any size, as tables."""

    classes: DataFrame  # iri, label
    edges: DataFrame  # child, parent
    categories: DataFrame  # category, category_label, required: non-OBO classes right under an anchor
    contradictions: DataFrame  # iri: everything below a class whose label speaks of a contradiction
    upward: DataFrame  # start, child, parent: every kernel edge met when walking up from start
    size: int
    version: str = UNVERSIONED

    def upward_table(self, spark) -> DataFrame:
        return self.upward

    def category_table(self, spark) -> DataFrame:
        return self.categories

    def totals(self) -> DataFrame:
        """(classes, categories, contradiction_types, version) in one row."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("version", F.lit(self.version))
        out = count(self.classes, "classes").join(count(self.categories, "categories"), "version")
        return out.join(count(self.contradictions, "contradiction_types"), "version")


def kernel_from_triples(spark: SparkSession, triples: DataFrame, ws=None) -> StoredKernel:
    """Read a kernel of any size out of its own (single-artifact) triples."""
    from quercus.operators.walks import closure
    from quercus.workspace import Workspace

    ws = ws or Workspace(spark)
    iri = F.col("s_kind") == "iri"
    classes = triples.where(
        iri & (F.col("p") == S.TYPE) & F.col("o").isin(S.CLASS, S.RDFS_CLASS)
    ).select(F.col("s").alias("iri"))
    labels = triples.where(F.col("p") == S.LABEL).groupBy(F.col("s").alias("iri")).agg(
        F.min("o").alias("label")
    )
    path, size = ws.write(
        classes.distinct().join(labels, "iri", "left").select("iri", F.coalesce("label", short_name(F.col("iri"))).alias("label")), "kernel-classes"
    )
    named = spark.read.schema("iri string, label string").parquet(path)
    edges = triples.where(iri & (F.col("p") == S.SUBCLASS) & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    edges = ws.table(edges.distinct(), "kernel-edges")
    above = ws.table(closure(edges.select(F.lit("").alias("artifact_id"), "child", "parent"), ws).select("child", "ancestor"), "kernel-above")
    found = edges.where(F.col("parent").isin(ANCHOR_IRIS) & ~F.col("child").startswith(S.OBO)).join(named.withColumnRenamed("iri", "child"), "child")
    roots = named.where(F.lower("label").contains("contradiction")).select(F.col("iri").alias("ancestor"))
    below = above.join(roots, "ancestor", "left_semi").select(F.col("child").alias("iri")).distinct()
    starts = above.select(F.col("child").alias("start"), F.col("ancestor").alias("child")).union(edges.select("child", "child"))
    upward = starts.distinct().join(edges, "child").select("start", "child", "parent").distinct()
    version = triples.where(F.col("p") == S.owl("versionInfo")).agg(F.min("o")).first()[0]
    return StoredKernel(
        named, edges, found.select(F.col("child").alias("category"), F.col("label").alias("category_label"), F.col("parent").alias("required")),
        below, ws.table(upward, "kernel-upward"), size, version or UNVERSIONED,
    )
