"""Artifact profile: entities by local name, axiom listing, expressivity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import local_name
from quercus.sources.tables import constant_table

# Entity kinds and the five listed axiom kinds.
ENTITY_KINDS = [
    (S.CLASS, "class"),
    (S.OBJECT_PROPERTY, "object_property"),
    (S.DATA_PROPERTY, "data_property"),
    (S.NAMED_INDIVIDUAL, "individual"),
    (S.ANNOTATION_PROPERTY, "annotation_property"),
]
AXIOM_KINDS = [
    (S.SUBCLASS, "SubClassOf", "⊑"),
    (S.EQUIVALENT, "EquivalentClass", "≡"),
    (S.DISJOINT, "DisjointWith", "⊥"),
    (S.DOMAIN, "Domain", "domain ⇒"),
    (S.RANGE, "Range", "range ⇒"),
]
CARDINALITIES = [
    S.owl(n)
    for n in (
        "minCardinality", "maxCardinality", "cardinality", "qualifiedCardinality",
        "minQualifiedCardinality", "maxQualifiedCardinality",
    )
]


def entities(triples: DataFrame) -> DataFrame:
    """(artifact_id, kind, name): distinct local names per entity kind."""
    kinds = constant_table(triples.sparkSession, "o string, kind string", ENTITY_KINDS)
    typed = triples.where(
        (F.col("p") == S.TYPE)
        & (F.col("s_kind") == "iri")
        & F.col("o").isin([iri for iri, _ in ENTITY_KINDS])
    )
    return (
        typed.join(kinds, "o")
        .select("artifact_id", "kind", local_name(F.col("s")).alias("name"))
        .where((F.col("name") != "") & ~F.col("name").isin("Thing", "Nothing"))
        .distinct()
    )


def axiom_listing(triples: DataFrame) -> DataFrame:
    """(artifact_id, axiom_type, description) over named subject and object."""
    kinds = constant_table(triples.sparkSession, "p string, axiom_type string, sep string", AXIOM_KINDS)
    named = triples.where(
        F.col("p").isin([p for p, _, _ in AXIOM_KINDS])
        & (F.col("s_kind") == "iri")
        & (F.col("o_kind") == "iri")
    )
    return (
        named.join(kinds, "p")
        .select(
            "artifact_id", "axiom_type", "sep",
            local_name(F.col("s")).alias("sn"), local_name(F.col("o")).alias("on"),
        )
        .where((F.col("sn") != "") & (F.col("on") != "") & ~F.col("sn").isin("Thing", "Nothing"))
        .select("artifact_id", "axiom_type", F.concat_ws(" ", "sn", "sep", "on").alias("description"))
    )


def imports(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == S.owl("imports")).select("artifact_id", F.col("o").alias("import_iri"))


def headers(triples: DataFrame) -> DataFrame:
    """(artifact_id, ontology_iri, ontology_name): the smallest declared header IRI."""
    found = (
        triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("Ontology")))
        .groupBy("artifact_id")
        .agg(F.min("s").alias("ontology_iri"))
    )
    return found.select(
        "artifact_id", "ontology_iri", local_name(F.col("ontology_iri")).alias("ontology_name")
    )


def expressivity(triples: DataFrame) -> DataFrame:
    """(artifact_id, expressivity): description-logic letters in fixed order."""
    p = F.col("p")

    def uses(*predicates):
        return F.bool_or(p.isin(*predicates))

    def typed(kind):
        return F.bool_or((p == S.TYPE) & (F.col("o") == S.owl(kind)))

    letters = [
        (uses(S.owl("unionOf")), "U"),
        (uses(S.owl("complementOf")), "C"),
        (uses(*CARDINALITIES), "N"),
        (uses(S.owl("inverseOf")), "I"),
        (uses(S.SUBPROPERTY), "H"),
        (typed("TransitiveProperty"), "R+"),
        (typed("FunctionalProperty"), "F"),
        (uses(S.owl("oneOf")), "O"),
    ]
    base = F.when(uses(S.owl("someValuesFrom")), "ALE").otherwise("AL")
    return triples.groupBy("artifact_id").agg(
        F.concat(base, *[F.when(c, letter).otherwise("") for c, letter in letters]).alias("expressivity")
    )


def profile(triples: DataFrame) -> DataFrame:
    """One row per artifact; name lists are the ``entities`` rows."""
    zero = F.lit(0).cast("bigint")
    named = entities(triples).groupBy("artifact_id").agg(
        F.count_if(F.col("kind") == "class").alias("classes"),
        F.count_if(F.col("kind") == "object_property").alias("object_properties"),
        F.count_if(F.col("kind") == "data_property").alias("data_properties"),
        F.count_if(F.col("kind") == "individual").alias("individuals"),
        F.count_if(F.col("kind") == "annotation_property").alias("annotation_properties"),
    )
    axioms = axiom_listing(triples).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("axiom_count"))
    imported = imports(triples).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("imports"))
    out = expressivity(triples)
    for part in (named, axioms, imported, headers(triples)):
        out = out.join(part, "artifact_id", "left")
    filled = [
        F.coalesce(c, zero).alias(c)
        for c in (
            "classes", "object_properties", "data_properties", "individuals",
            "annotation_properties", "axiom_count", "imports",
        )
    ]
    return out.select(
        "artifact_id",
        F.coalesce("ontology_iri", F.lit("")).alias("ontology_iri"),
        F.coalesce("ontology_name", F.lit("Unknown Ontology")).alias("ontology_name"),
        *filled,
        "expressivity",
    )
