"""Class, property and individual tables turned into triples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.workspace import dealt, spread

#: How many triples a row of these tables gives at most, without property values.
ROW_TRIPLES = 6


def _rows(df: DataFrame, *triples) -> DataFrame:
    """``triples``: (subject, predicate, object, object kind, condition) column tuples."""
    cells = [
        F.when(
            cond,
            F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")),
        )
        for s, p, o, kind, cond in triples
    ]
    return df.select("artifact_id", F.inline(F.filter(F.array(*cells), lambda r: r.isNotNull())))


def _described(iri, kind):
    yes, name = F.lit(True), F.col("name")
    return [
        (iri, F.lit(S.TYPE), kind, "iri", yes),
        (iri, F.lit(S.LABEL), name, "literal", yes),
        (iri, F.lit(S.COMMENT), F.coalesce("description", F.lit("")), "literal", yes),
    ]


def tables_to_triples(
    classes: DataFrame, properties: DataFrame, individuals: DataFrame, base: str
) -> DataFrame:
    """Triples of tables that describe ontologies relationally.

    classes(artifact_id, id, name, description, upper_id, parent_id);
    properties(artifact_id, id, name, description, property_type, domain_class_id, range_class_id);
    individuals(artifact_id, id, name, description, class_id, property_values map<bigint,string>).
    Entity IRIs are ``base`` + artifact + '#' + name.
    """
    rows = (classes.count() + properties.count() + individuals.count()) * ROW_TRIPLES
    classes, individuals = (spread(t, ROW_TRIPLES, "artifact_id", "id") for t in (classes, individuals))

    def iri(name):
        return F.concat(F.lit(base), F.col("artifact_id"), F.lit("#"), F.col(name))

    names = classes.select("artifact_id", F.col("id").alias("ref"), F.col("name").alias("ref_name"))

    def named(df, ref, out):
        side = names.withColumnsRenamed({"ref": ref, "ref_name": out})
        return df.join(side, ["artifact_id", ref], "left")

    sub = F.lit(S.SUBCLASS)
    class_rows = _rows(
        named(classes, "parent_id", "parent_name"),
        *_described(iri("name"), F.lit(S.CLASS)),
        (iri("name"), sub, F.concat(F.lit(S.UPPER_PREFIX), "upper_id"), "iri", F.col("upper_id").isNotNull()),
        (iri("name"), sub, iri("parent_name"), "iri", F.col("parent_name").isNotNull()),
    )
    kind = F.col("property_type")
    prop_type = (
        F.when(kind == "object", S.OBJECT_PROPERTY).when(kind == "data", S.DATA_PROPERTY)
        .otherwise(S.ANNOTATION_PROPERTY)
    )
    scoped = named(named(properties, "domain_class_id", "domain_name"), "range_class_id", "range_name")
    prop_rows = _rows(
        scoped,
        *_described(iri("name"), prop_type),
        (iri("name"), F.lit(S.DOMAIN), iri("domain_name"), "iri",
         F.col("domain_name").isNotNull() & kind.isin("object", "data")),
        (iri("name"), F.lit(S.RANGE), iri("range_name"), "iri",
         F.col("range_name").isNotNull() & (kind == "object")),
        (iri("name"), F.lit(S.RANGE), F.lit(S.XSD + "string"), "iri", kind == "data"),
    )
    ind_rows = _rows(
        named(individuals, "class_id", "class_name"),
        *_described(iri("name"), F.lit(S.NAMED_INDIVIDUAL)),
        (iri("name"), F.lit(S.TYPE), iri("class_name"), "iri", F.col("class_name").isNotNull()),
    )
    values = individuals.select(
        "artifact_id", F.col("name").alias("owner"), F.explode("property_values").alias("prop_id", "value")
    ).join(
        properties.select("artifact_id", F.col("id").alias("prop_id"), F.col("name").alias("prop_name"), "property_type"),
        ["artifact_id", "prop_id"],
    )
    linked = (
        values.where("property_type = 'object'")
        .withColumn("target_id", F.col("value").cast("bigint"))
        .join(
            individuals.select("artifact_id", F.col("id").alias("target_id"), F.col("name").alias("target")),
            ["artifact_id", "target_id"],
        )
    )
    yes = F.lit(True)
    link_rows = _rows(linked, (iri("owner"), iri("prop_name"), iri("target"), "iri", yes))
    value_rows = _rows(
        values.where("property_type <> 'object'"), (iri("owner"), iri("prop_name"), F.col("value"), "literal", yes)
    )
    out = class_rows.union(prop_rows).union(ind_rows).union(link_rows).union(value_rows)
    literal = F.col("o_kind") == "literal"
    out = dealt(out, rows, "artifact_id", "s")  # equal triples meet in one task, which holds few
    return out.select(
        "artifact_id", "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind",
        F.when(literal, S.XSD + "string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    ).distinct()
