"""The upper ontology: category tree, labels, disjointness and their closures.

The built-in upper ontology is a fixed vocabulary of a few dozen classes, so its tables
are constants that every plan may broadcast (``Upper``).  Any other one, of whatever size, is read by
``upper_from_triples`` into written tables (``StoredUpper``) that answer the same questions: ancestors come from a walk, and
whether two categories clash is asked for the pairs at hand, by the disjoint groups they fall under, so no table of
all clashing pairs is ever made.
"""

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.sources.tables import constant_table

CONTINUANT = S.UPPER_PREFIX + "0000002"
OCCURRENT = S.UPPER_PREFIX + "0000003"
MATERIAL = S.UPPER_PREFIX + "0000040"
IMMATERIAL = S.UPPER_PREFIX + "0000141"

# The 36 classes of BFO 2020 (ISO/IEC 21838-2): id, label, parent id.
CLASSES = [
    ("0000001", "entity", None),
    ("0000002", "continuant", "0000001"),
    ("0000003", "occurrent", "0000001"),
    ("0000004", "independent continuant", "0000002"),
    ("0000006", "spatial region", "0000141"),
    ("0000008", "temporal region", "0000003"),
    ("0000009", "two-dimensional spatial region", "0000006"),
    ("0000011", "spatiotemporal region", "0000003"),
    ("0000015", "process", "0000003"),
    ("0000016", "disposition", "0000017"),
    ("0000017", "realizable entity", "0000020"),
    ("0000018", "zero-dimensional spatial region", "0000006"),
    ("0000019", "quality", "0000020"),
    ("0000020", "specifically dependent continuant", "0000002"),
    ("0000023", "role", "0000017"),
    ("0000024", "fiat object part", "0000040"),
    ("0000026", "one-dimensional spatial region", "0000006"),
    ("0000027", "object aggregate", "0000040"),
    ("0000028", "three-dimensional spatial region", "0000006"),
    ("0000029", "site", "0000141"),
    ("0000030", "object", "0000040"),
    ("0000031", "generically dependent continuant", "0000002"),
    ("0000034", "function", "0000016"),
    ("0000035", "process boundary", "0000003"),
    ("0000038", "one-dimensional temporal region", "0000008"),
    ("0000040", "material entity", "0000004"),
    ("0000140", "continuant fiat boundary", "0000141"),
    ("0000141", "immaterial entity", "0000004"),
    ("0000142", "fiat line", "0000140"),
    ("0000145", "relational quality", "0000019"),
    ("0000146", "fiat surface", "0000140"),
    ("0000147", "fiat point", "0000140"),
    ("0000148", "zero-dimensional temporal region", "0000008"),
    ("0000182", "history", "0000015"),
    ("0000202", "temporal interval", "0000038"),
    ("0000203", "temporal instant", "0000148"),
]
# Asserted disjointness, as groups of pairwise disjoint classes.
DISJOINT_GROUPS = [
    ("0000002", "0000003"),
    ("0000016", "0000023"),
    ("0000017", "0000019"),
    ("0000038", "0000148"),
    ("0000040", "0000141"),
    ("0000004", "0000020", "0000031"),
    ("0000006", "0000029", "0000140"),
    ("0000008", "0000011", "0000015", "0000035"),
    ("0000009", "0000018", "0000026", "0000028"),
    ("0000142", "0000146", "0000147"),
]


@dataclass(frozen=True)
class Upper:
    """labels: iri -> label; parents: iri -> parent iris; disjoint: sorted pairs."""

    labels: dict
    parents: dict
    disjoint: frozenset

    @cached_property
    def ancestors(self) -> dict:
        """iri -> its ancestors, itself included."""
        out = {}
        for iri in self.labels:
            reached, frontier = {iri}, {iri}
            while frontier:
                frontier = {p for c in frontier for p in self.parents.get(c, ())} - reached
                reached |= frontier
            out[iri] = reached
        return out

    @cached_property
    def clashes(self) -> frozenset:
        """Sorted pairs whose ancestor sets hit both sides of a disjoint pair."""
        anc = self.ancestors
        return frozenset(
            (a, b)
            for a, b in combinations(sorted(self.labels), 2)
            if any(
                (x in anc[a] and y in anc[b]) or (y in anc[a] and x in anc[b])
                for x, y in self.disjoint
            )
        )

    def drop_of(self, a: str, b: str) -> str:
        """Of two clashing categories, the one to let go: the broader, else the later IRI."""
        depth_a, depth_b = len(self.ancestors[a]), len(self.ancestors[b])
        if depth_a == depth_b:
            return max(a, b)
        return a if depth_a < depth_b else b

    def clash_case(self, a: str, b: str) -> str:
        def split(x, y):
            return (x in self.ancestors[a] and y in self.ancestors[b]) or (
                y in self.ancestors[a] and x in self.ancestors[b]
            )

        if {self.labels[a].lower(), self.labels[b].lower()} == {"quality", "disposition"}:
            return "quality_disposition"
        if split(CONTINUANT, OCCURRENT):
            return "continuant_occurrent"
        if split(MATERIAL, IMMATERIAL):
            return "material_immaterial"
        return "generic"

    # -- broadcastable tables ---------------------------------------------

    def label_table(self, spark) -> DataFrame:
        return constant_table(spark, "iri string, label string", sorted(self.labels.items()))

    def edge_table(self, spark) -> DataFrame:
        rows = sorted((c, p) for c, ps in self.parents.items() for p in ps)
        return constant_table(spark, "child string, parent string", rows)

    def ancestor_table(self, spark) -> DataFrame:
        rows = sorted((c, a) for c, anc in self.ancestors.items() for a in anc)
        return constant_table(spark, "iri string, ancestor string", rows)

    def clash_table(self, spark) -> DataFrame:
        """One row per clashing pair a < b with labels, wording case and the side to drop."""
        rows = [
            (a, b, self.labels[a], self.labels[b], self.clash_case(a, b), self.drop_of(a, b))
            for a, b in sorted(self.clashes)
        ]
        return constant_table(
            spark,
            "a string, b string, label_a string, label_b string, clash_case string, drop_iri string",
            rows,
        )

    def clashing(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a < b, and what else they carry) that clash, with labels, wording case and the side to drop."""
        return pairs.join(self.clash_table(pairs.sparkSession), ["a", "b"])

    def clash_sides(self, spark, among=None) -> DataFrame:
        """Both directions: category -> category it clashes with; ``among`` is for upper ontologies that have to be asked."""
        rows = sorted({p for a, b in self.clashes for p in ((a, b), (b, a))})
        return constant_table(spark, "category string, other string", rows)


@dataclass(frozen=True)
class StoredUpper:
    """An upper ontology of any size, as tables."""

    labels: DataFrame  # iri, label
    edges: DataFrame  # child, parent
    ancestors: DataFrame  # iri, ancestor: itself included
    sides: DataFrame  # iri, group_id, member: members of disjoint groups that a category falls under

    def label_table(self, spark) -> DataFrame:
        return self.labels

    def edge_table(self, spark) -> DataFrame:
        return self.edges

    def ancestor_table(self, spark) -> DataFrame:
        return self.ancestors

    def clashing(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a < b, and what else they carry) that clash, with labels, wording case and the side to drop."""
        asked = pairs.select("a", "b").distinct()
        left = asked.join(self.sides.select(F.col("iri").alias("a"), "group_id", F.col("member").alias("x")), "a")
        both = left.join(self.sides.select(F.col("iri").alias("b"), "group_id", F.col("member").alias("y")), ["b", "group_id"])
        found = both.where("x <> y").select("a", "b").distinct()
        under = lambda n: F.bool_or(F.col("ancestor") == n)
        told = self.ancestors.groupBy("iri").agg(
            F.count(F.lit(1)).alias("depth"), under(CONTINUANT).alias("c"), under(OCCURRENT).alias("o"),
            under(MATERIAL).alias("m"), under(IMMATERIAL).alias("i"),
        ).join(self.labels, "iri")
        for side in ("a", "b"):
            known = told.select(F.col("iri").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in ("label", "depth", "c", "o", "m", "i")])
            found = found.join(known, side)
        split = lambda x, y: (F.col(f"{x}_a") & F.col(f"{y}_b")) | (F.col(f"{y}_a") & F.col(f"{x}_b"))
        names = F.array_sort(F.array(F.lower("label_a"), F.lower("label_b")))
        case = (
            F.when(names == F.array(F.lit("disposition"), F.lit("quality")), "quality_disposition")
            .when(split("c", "o"), "continuant_occurrent").when(split("m", "i"), "material_immaterial").otherwise("generic")
        )
        drop = F.when(F.col("depth_a") == F.col("depth_b"), F.greatest("a", "b")).when(F.col("depth_a") < F.col("depth_b"), F.col("a")).otherwise(F.col("b"))
        return pairs.join(found.select("a", "b", "label_a", "label_b", case.alias("clash_case"), drop.alias("drop_iri")), ["a", "b"])

    def clash_sides(self, spark, among=None) -> DataFrame:
        """Both directions between the categories ``among``, a list whose pairs are asked for."""
        pairs = constant_table(spark, "a string, b string", combinations(sorted(among or ()), 2))
        found = self.clashing(pairs)
        return found.select(F.col("a").alias("category"), F.col("b").alias("other")).union(found.select("b", "a"))


def builtin_upper() -> Upper:
    full = lambda n: S.UPPER_PREFIX + n
    return Upper(
        labels={full(i): label for i, label, _ in CLASSES},
        parents={full(i): (full(p),) for i, _, p in CLASSES if p},
        disjoint=frozenset(
            (full(a), full(b)) for g in DISJOINT_GROUPS for a, b in combinations(sorted(g), 2)
        ),
    )


def upper_from_triples(spark: SparkSession, triples: DataFrame, ws=None) -> StoredUpper:
    """Read an upper ontology of any size out of its own (single-artifact) triples."""
    from quercus.operators.disjointness import disjoint_groups
    from quercus.operators.walks import closure
    from quercus.workspace import Workspace

    ws = ws or Workspace(spark)
    is_up = lambda c: F.col(c).startswith(S.UPPER_PREFIX)
    classes = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.CLASS) & is_up("s")).select(
        F.col("s").alias("iri")
    )
    labels = triples.where(F.col("p") == S.LABEL).groupBy(F.col("s").alias("iri")).agg(
        F.min("o").alias("label")
    )
    fallback = F.initcap(F.replace(F.substring_index("iri", "/", -1), F.lit("_"), F.lit(" ")))
    named = ws.table(
        classes.distinct().join(labels, "iri", "left").select("iri", F.coalesce("label", fallback).alias("label")), "upper-classes"
    )
    edges = triples.where((F.col("p") == S.SUBCLASS) & is_up("s") & is_up("o")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    edges = ws.table(edges.distinct(), "upper-edges")
    above = closure(edges.select(F.lit("").alias("artifact_id"), "child", "parent"), ws).select(F.col("child").alias("iri"), "ancestor")
    ancestors = ws.table(above.union(named.select("iri", F.col("iri").alias("ancestor"))).distinct(), "upper-ancestors")
    listed = disjoint_groups(triples, ws).where(is_up("member")).select("group_id", "member")
    sides = ancestors.join(listed.withColumnRenamed("member", "ancestor"), "ancestor").select("iri", "group_id", F.col("ancestor").alias("member"))
    return StoredUpper(named, edges, ancestors, ws.table(sides, "upper-sides"))


# The second, hand-kept vocabulary for formulas: (key, IRI id), classes then relations.
VOCABULARY_CLASSES = [
    ("entity", "0000001"), ("continuant", "0000002"), ("occurrent", "0000003"),
    ("independent_continuant", "0000004"), ("specifically_dependent_continuant", "0000020"),
    ("generically_dependent_continuant", "0000031"), ("process", "0000015"),
    ("material_entity", "0000040"), ("immaterial_entity", "0000141"),
    ("spatial_region", "0000006"), ("quality", "0000019"), ("realizable_entity", "0000017"),
    ("role", "0000023"), ("disposition", "0000016"), ("function", "0000034"),
    ("site", "0000029"), ("object", "0000030"), ("object_aggregate", "0000027"),
    ("fiat_object_part", "0000024"), ("process_boundary", "0000035"),
    ("temporal_region", "0000008"), ("continuant_fiat_boundary", "0000140"),
    ("zero_dimensional_spatial_region", "0000018"),
    ("one_dimensional_spatial_region", "0000026"),
    ("two_dimensional_spatial_region", "0000009"),
    ("three_dimensional_spatial_region", "0000028"), ("history", "0000182"),
    ("relational_quality", "0000145"), ("spatiotemporal_region", "0000011"),
    ("temporal_instant", "0000148"), ("connected_temporal_region", "0000311"),
    ("scattered_temporal_region", "0000032"), ("process_profile", "0000144"),
]
VOCABULARY_RELATIONS = [
    ("part_of", "0000050"), ("has_part", "0000051"), ("located_in", "0000082"),
    ("location_of", "0000124"), ("contained_in", "0000082"), ("contains", "0000081"),
    ("participates_in", "0000056"), ("has_participant", "0000057"), ("bearer_of", "0000053"),
    ("inheres_in", "0000052"), ("realized_in", "0000054"), ("realizes", "0000055"),
    ("exists_at", "0000108"), ("instance_of", "0000110"), ("occurs_in", "0000066"),
    ("has_quality", "0000086"), ("quality_of", "0000080"), ("has_material_basis", "0000127"),
    ("material_basis_of", "0000126"), ("concretizes", "0000059"),
    ("concretization_of", "0000058"), ("has_first_instant", "0000153"),
    ("has_last_instant", "0000154"), ("preceded_by", "0000060"), ("precedes", "0000061"),
    ("spatially_contains", "0000175"), ("spatially_contained_in", "0000176"),
    ("temporally_contains", "0000177"), ("temporally_contained_in", "0000178"),
    ("temporal_part_of", "0000186"), ("has_temporal_part", "0000187"),
]


def vocabulary_rows():
    """(position, key, label, uri, kind) in listing order: classes, then relations."""
    rows = [(k, n, "class") for k, n in VOCABULARY_CLASSES]
    rows += [(k, n, "relation") for k, n in VOCABULARY_RELATIONS]
    return [
        (i, k, k.replace("_", " ").title(), S.UPPER_PREFIX + n, kind)
        for i, (k, n, kind) in enumerate(rows)
    ]


def vocabulary_table(spark) -> DataFrame:
    return constant_table(
        spark, "pos bigint, key string, label string, uri string, kind string", vocabulary_rows()
    )
