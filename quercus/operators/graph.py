"""Graph tables for visual tools, and name-based rules over them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import (
    is_temporal_name, local_name, node_type, path_name, suggests, suggests_class,
)
from quercus.operators.rules import assertions
from quercus.sources.upper import VOCABULARY_CLASSES

RELATIONS = ["inheres_in", "has_property", "points_to"]
# Category names that exclude each other by name.
DISJOINT_NAMES = [
    ("MaterialEntity", "ImmaterialEntity"),
    ("IndependentContinuant", "DependentContinuant"),
    ("Process", "Continuant"),
]


def _named(triples: DataFrame, kind: str) -> DataFrame:
    return triples.where(
        (F.col("p") == S.TYPE) & (F.col("o") == kind) & (F.col("s_kind") == "iri")
    ).select("artifact_id", F.col("s").alias("id")).distinct()


def nodes(triples: DataFrame, fixed: bool = False) -> DataFrame:
    """(artifact_id, id, name, type, description, temporal): classes, and object properties as relations."""
    comments = triples.where(F.col("p") == S.COMMENT).groupBy("artifact_id", F.col("s").alias("id")).agg(
        F.min("o").alias("comment")
    )
    keys = [k for k, _ in VOCABULARY_CLASSES]
    name = local_name(F.col("id"))

    def rows(df, what, type_, temporal):
        return df.join(comments, ["artifact_id", "id"], "left").select(
            "artifact_id", "id", name.alias("name"), type_.alias("type"),
            F.coalesce("comment", F.concat(F.lit(what), name)).alias("description"), temporal.alias("temporal"),
        )

    classes = rows(_named(triples, S.CLASS), "OWL class: ", node_type(name, keys, fixed), is_temporal_name(name))
    props = rows(_named(triples, S.OBJECT_PROPERTY), "OWL property: ", F.lit("Relation"), F.lit(False))
    return classes.union(props)


def edges(triples: DataFrame) -> DataFrame:
    """(artifact_id, source, target, relation, type); is_a runs from parent to child."""
    both = (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
    classes, props = (_named(triples, k).withColumnRenamed("id", "s") for k in (S.CLASS, S.OBJECT_PROPERTY))

    def rows(p, owners, source, target, relation, type_):
        return triples.where((F.col("p") == p) & both).join(owners, ["artifact_id", "s"], "left_semi").select(
            "artifact_id", F.col(source).alias("source"), F.col(target).alias("target"),
            F.lit(relation).alias("relation"), F.lit(type_).alias("type"),
        )

    return (
        rows(S.SUBCLASS, classes, "o", "s", "is_a", "inheritance")
        .union(rows(S.DOMAIN, props, "o", "s", "has_property", "domain"))
        .union(rows(S.RANGE, props, "s", "o", "points_to", "range"))
    )


def summary(node_rows: DataFrame) -> DataFrame:
    relation = F.col("type") == "Relation"
    return node_rows.groupBy("artifact_id").agg(
        F.count_if(~relation).alias("class_count"), F.count_if(relation).alias("property_count")
    )


def property_connections(triples: DataFrame) -> DataFrame:
    """(artifact_id, source, target, label): domain class to range class, per object property."""
    owners = _named(triples, S.OBJECT_PROPERTY).withColumnRenamed("id", "s")
    both = (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")

    def end(p, name):
        return triples.where((F.col("p") == p) & both).join(owners, ["artifact_id", "s"], "left_semi").select(
            "artifact_id", "s", local_name(F.col("o")).alias(name)
        )

    return end(S.DOMAIN, "source").join(end(S.RANGE, "target"), ["artifact_id", "s"]).select(
        "artifact_id", "source", "target", local_name(F.col("s")).alias("label")
    )


def diagram_classes(triples: DataFrame) -> DataFrame:
    iri = F.col("id")
    return _named(triples, S.CLASS).select(
        "artifact_id", local_name(iri).alias("name"), (iri.contains("BFO") | iri.contains("IAO")).alias("upper")
    )


# -- rules --------------------------------------------------------------------

VIOLATION = ["artifact_id", "rule_id", "rule_path", "source", "property", "target", "description"]


def _violation(df, rule, path, source, prop, target, text) -> DataFrame:
    return df.select(
        "artifact_id", F.lit(rule).alias("rule_id"), F.lit(path).alias("rule_path"), source.alias("source"),
        prop.alias("property"), target.alias("target"), text.alias("description"),
    )


def quality_violations(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Qualities tied to immaterial things, by each of the three ways they are noticed.

    The same fault may be reported by more than one ``rule_path``, as it always was.
    """
    rule, f = "quality_inheres_material", F.format_string
    src, dst, rel = path_name(F.col("source")), path_name(F.col("target")), F.col("relation")
    tied = edge_rows.where(rel.isin(RELATIONS)).select("artifact_id", "relation", src.alias("src"), dst.alias("dst"))
    src, dst = F.col("src"), F.col("dst")
    wrong = tied.where(suggests("immaterial", dst))
    by_edge = _violation(
        wrong.where(suggests("quality", src)), rule, "edge", src, rel, dst,
        f("'%s' reads as a quality and '%s' as immaterial; a quality needs a material bearer", src, dst),
    )
    by_property = _violation(
        tied.where((F.lower(src) == "inheres_in") & F.lower(dst).isin("immaterialentity", "voidspace")),
        rule, "property", F.lit("inheres_in property"), rel, dst,
        f("inheres_in leads to '%s', which is nothing material", dst),
    )
    quality_nodes = node_rows.select("artifact_id", path_name(F.col("name")).alias("src")).where(suggests("quality", src))
    by_node = _violation(
        wrong.join(quality_nodes, ["artifact_id", "src"]), rule, "node", src, rel, dst,
        f("the node '%s' reads as a quality and is tied to the immaterial '%s'", src, dst),
    )
    return by_edge.union(by_property).union(by_node)


def _bearing(edge_rows, relations, subject, allowed, rule, prop, text):
    src, dst = path_name(F.col("source")), path_name(F.col("target"))
    bad = edge_rows.where(F.col("relation").isin(relations) & suggests(subject, src) & ~suggests(allowed, dst))
    return _violation(bad, rule, "edge", src, F.lit(prop), dst, F.format_string(text, src, dst))


def role_violations(edge_rows: DataFrame) -> DataFrame:
    return _bearing(
        edge_rows, ["borne_by", "has_bearer"], "role", "independent", "role_borne_independent", "borne_by",
        "'%s' reads as a role, and its bearer '%s' is no independent continuant",
    )


def disposition_violations(edge_rows: DataFrame) -> DataFrame:
    return _bearing(
        edge_rows, ["realizes", "realized_in"], "disposition", "process", "disposition_realizes_process", "realized_in",
        "'%s' reads as a disposition, and '%s', where it is realised, is no process",
    )


def disjoint_name_violations(node_rows: DataFrame) -> DataFrame:
    """Nodes whose name suggests both sides of one of the three exclusive pairs."""
    name = path_name(F.col("name"))

    def clash(a: str, b: str) -> Column:
        return F.when(
            suggests_class(a, name) & suggests_class(b, name),
            F.format_string(f"'%s' reads as {a} and as {b}, which exclude each other", name),
        )

    texts = F.filter(F.array(*[clash(a, b) for a, b in DISJOINT_NAMES]), lambda t: t.isNotNull())
    hit = node_rows.select("artifact_id", "name", F.explode(texts).alias("text"))
    none = F.lit(None).cast("string")
    return _violation(hit, "disjoint_classes", "node", name, none, none, F.col("text"))


def instance_violations(triples: DataFrame) -> DataFrame:
    """Quality-like individuals that inhere in immaterial-like values."""
    src, dst = path_name(F.col("s")), path_name(F.col("o"))
    bad = assertions(triples).where(
        (path_name(F.col("p")) == "inheres_in") & suggests("quality", src) & suggests("immaterial", dst)
    )
    text = "the individual '%s' reads as a quality and inheres in the immaterial '%s'"
    return _violation(
        bad, "quality_inheres_material_instance", "instance", src, F.lit("inheres_in"), dst,
        F.format_string(text, src, dst),
    )


def valid_relations(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.where("relation = 'is_a'").select(
        "artifact_id", F.col("relation").alias("property"), path_name(F.col("source")).alias("source"),
        path_name(F.col("target")).alias("target"), F.lit("passed").alias("validation_status"),
    )


def violations(triples: DataFrame, node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return (
        quality_violations(node_rows, edge_rows)
        .union(role_violations(edge_rows))
        .union(disposition_violations(edge_rows))
        .union(disjoint_name_violations(node_rows))
        .union(instance_violations(triples))
    )


def validation_totals(node_rows: DataFrame, edge_rows: DataFrame, violation_rows: DataFrame) -> DataFrame:
    """(artifact_id, total_entities, total_relations, errors, valid)."""
    def tally(df, name, when=None):
        n = F.count(F.lit(1)) if when is None else F.count_if(when)
        return df.groupBy("artifact_id").agg(n.alias(name))

    zero = F.lit(0).cast("bigint")
    out = tally(node_rows, "total_entities")
    out = out.join(tally(edge_rows, "total_relations"), "artifact_id", "left")
    out = out.join(tally(violation_rows, "errors"), "artifact_id", "left")
    out = out.join(tally(edge_rows, "valid", F.col("relation") == "is_a"), "artifact_id", "left")
    return out.select(
        "artifact_id", "total_entities",
        *[F.coalesce(c, zero).alias(c) for c in ("total_relations", "errors", "valid")],
    )
