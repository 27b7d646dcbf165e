"""Premise rows, typed axiom rows and the coverage of entities by premises."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.formulas import PREMISE_TERM
from quercus.functions.names import local_name
from quercus.operators.counts import CHARACTERISTICS
from quercus.operators.disjointness import PAIRED, asserted_pairs, disjoint_groups, property_chains, sized
from quercus.operators.profile import entities
from quercus.operators.ranking import grouped_rank
from quercus.operators.rules import assertions
from quercus.workspace import Workspace

NOT_PREMISED = ["Thing", "Nothing", "Entity"]
CHAR_NAMES = {iri: iri.rsplit("#", 1)[-1].removesuffix("Property") for iri in CHARACTERISTICS}


def simple_premises(triples: DataFrame) -> DataFrame:
    """One premise per class and per object property name."""
    named = entities(triples).where(
        ((F.col("kind") == "class") & ~F.col("name").isin(NOT_PREMISED)) | (F.col("kind") == "object_property")
    )
    is_class, name = F.col("kind") == "class", F.col("name")
    return named.select(
        "artifact_id",
        F.when(is_class, "class").otherwise("property").alias("premise_type"),
        F.when(is_class, F.format_string("instance_of(x, %s, t)", name))
        .otherwise(F.format_string("%s(x, y, t)", name)).alias("fol"),
        F.when(is_class, F.concat(F.lit("Entities that are instances of "), name))
        .otherwise(F.format_string("Relation %s between entities", name)).alias("description"),
        F.col("name").alias("entity_name"),
    )


def missing_entities(triples: DataFrame, premises: DataFrame) -> DataFrame:
    """(artifact_id, kind, name) of classes, properties and individuals no premise is about."""
    wanted = entities(triples).where("kind <> 'annotation_property'")
    about = premises.select("artifact_id", F.col("entity_name").alias("name")).distinct()
    return wanted.join(about, ["artifact_id", "name"], "left_anti").select("artifact_id", "kind", "name")


def completeness(triples: DataFrame, premises: DataFrame) -> DataFrame:
    """Totals and missing counts per artifact."""
    zero = F.lit(0).cast("bigint")
    total = entities(triples).where("kind <> 'annotation_property'").groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("total_entities")
    )
    lacking = missing_entities(triples, premises).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("missing"))
    n = premises.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("premises"))
    return (
        total.join(lacking, "artifact_id", "left").join(n, "artifact_id", "left")
        .select(
            "artifact_id", "total_entities", F.coalesce("missing", zero).alias("missing_entities"),
            F.coalesce("premises", zero).alias("total_premises"),
            (F.coalesce("missing", zero) == 0).alias("complete"),
        )
    )


# Typed axiom kinds by predicate: (kind, verb).
AXIOM_VERBS = {
    S.SUBCLASS: ("SubClassOf", "is a subclass of"),
    S.EQUIVALENT: ("EquivalentClasses", "is equivalent to"),
    S.DISJOINT: ("DisjointClasses", "is disjoint with"),
}


def typed_axioms(triples: DataFrame) -> DataFrame:
    """(artifact_id, axiom_type, subject, property, object, description) of the older, wider listing."""
    both = (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
    s, o, none = local_name(F.col("s")), local_name(F.col("o")), F.lit(None).cast("string")
    cols = ["artifact_id", "axiom_type", "subject", "property", "object", "description"]

    def rows(df, kind, text, prop=None, obj=o):
        return df.select(
            "artifact_id", kind.alias("axiom_type"), s.alias("subject"),
            (none if prop is None else prop).alias("property"), obj.alias("object"), text.alias("description"),
        )

    kind, verb = none, none
    for iri, (k, v) in AXIOM_VERBS.items():
        kind = F.when(F.col("p") == iri, k).otherwise(kind)
        verb = F.when(F.col("p") == iri, v).otherwise(verb)
    class_axioms = rows(
        triples.where(F.col("p").isin(*AXIOM_VERBS) & both), kind, F.concat_ws(" ", s, verb, o)
    )
    props = triples.where(
        (F.col("p") == S.TYPE) & F.col("o").isin(S.OBJECT_PROPERTY, S.DATA_PROPERTY) & (F.col("s_kind") == "iri")
    ).groupBy("artifact_id", "s").agg(F.bool_or(F.col("o") == S.OBJECT_PROPERTY).alias("is_object"))
    scope = triples.where(F.col("p").isin(S.DOMAIN, S.RANGE) & both).join(props, ["artifact_id", "s"])
    end = F.when(F.col("p") == S.DOMAIN, "Domain").otherwise("Range")
    scoped = rows(
        scope,
        F.concat(F.when(F.col("is_object"), "ObjectProperty").otherwise("DataProperty"), end),
        F.concat_ws(" ", s, F.lit("has"), F.lower(end), o),
    )
    char = none
    for iri, name in CHAR_NAMES.items():
        char = F.when(F.col("o") == iri, name).otherwise(char)
    object_props = props.where("is_object").select("artifact_id", "s")
    chars = triples.where((F.col("p") == S.TYPE) & F.col("o").isin(CHARACTERISTICS)).join(
        object_props, ["artifact_id", "s"], "left_semi"
    )
    characteristics = rows(chars, char, F.concat_ws(" ", s, F.lit("is"), F.lower(char)), obj=none)
    classes = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.CLASS)).select(
        "artifact_id", F.col("s").alias("o")
    ).distinct()
    asserted = triples.where((F.col("p") == S.TYPE) & both).join(classes, ["artifact_id", "o"], "left_semi")
    members = rows(asserted, F.lit("ClassAssertion"), F.concat_ws(" ", s, F.lit("is an instance of"), o))
    p = local_name(F.col("p"))
    linked = rows(assertions(triples), F.lit("ObjectPropertyAssertion"), F.concat_ws(" ", s, p, o), prop=p)
    data_props = props.where("NOT is_object").select("artifact_id", F.col("s").alias("p"))
    valued = triples.where((F.col("o_kind") == "literal") & (F.col("s_kind") == "iri")).join(
        data_props, ["artifact_id", "p"], "left_semi"
    )
    values = rows(valued, F.lit("DataPropertyAssertion"), F.concat_ws(" ", s, p, "o"), prop=p, obj=F.col("o"))
    out = class_axioms
    for part in (scoped, characteristics, members, linked, values):
        out = out.union(part)
    return out.select(*cols)


def axioms_mentioning(axioms: DataFrame, terms: DataFrame) -> DataFrame:
    """Axioms whose subject, property or object is one of ``terms(artifact_id, term)``."""
    tagged = axioms.withColumn("id", F.xxhash64(*axioms.columns))
    named = tagged.select(
        "artifact_id", "id", F.explode(F.array_distinct(F.array("subject", "property", "object"))).alias("term")
    ).where("term IS NOT NULL")
    hit = named.join(terms, ["artifact_id", "term"], "left_semi").select("artifact_id", "id").distinct()
    return tagged.join(hit, ["artifact_id", "id"], "left_semi").drop("id")


def _numbered(n: Column, letter: str) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(letter), i.cast("string")))


def _related(prop: Column, names: Column) -> Column:
    return F.transform(names, lambda v: F.concat(prop, F.lit("(x,"), v, F.lit(")")))


def _compared(names: Column, sign: str) -> Column:
    later = F.transform(
        names,
        lambda v, i: F.transform(
            F.slice(names, i + 2, F.size(names)), lambda w: F.concat(v, F.lit(f" {sign} "), w)
        ),
    )
    return F.flatten(later)


CARDINALITIES = {
    S.owl("minCardinality"): "min", S.owl("minQualifiedCardinality"): "min",
    S.owl("maxCardinality"): "max", S.owl("maxQualifiedCardinality"): "max",
    S.owl("cardinality"): "exact", S.owl("qualifiedCardinality"): "exact",
}
#: Bounds up to this are spelled out with a variable each; larger ones are written with a counting quantifier.
SPELLED = 8


def cardinality_errors(triples: DataFrame) -> DataFrame:
    """(artifact_id, node, value, error): cardinality literals that are no whole number from 0 on; they give no premise."""
    bad = triples.where(F.col("p").isin(*CARDINALITIES) & ~F.coalesce(F.expr("try_cast(o AS INT)") >= 0, F.lit(False)))
    return bad.select("artifact_id", F.col("s").alias("node"), F.col("o").alias("value"), F.lit("E_LITERAL").alias("error"))


def cardinality_premises(triples: DataFrame) -> DataFrame:
    """Min / max / exact cardinality restrictions as formulas, spelled out up to ``SPELLED``.

    A literal that is no whole number from 0 on gives no premise, see ``cardinality_errors``.
    """
    kind = F.lit(None).cast("string")
    for iri, k in CARDINALITIES.items():
        kind = F.when(F.col("p") == iri, k).otherwise(kind)
    bounds = triples.where(F.col("p").isin(*CARDINALITIES)).select(
        "artifact_id", F.col("s").alias("node"), kind.alias("kind"), F.expr("try_cast(o AS INT)").alias("n")
    ).where("n >= 0")
    on = triples.where(F.col("p") == S.owl("onProperty")).select(
        "artifact_id", F.col("s").alias("node"), local_name(F.col("o")).alias("prop")
    )
    users = triples.where((F.col("p") == S.SUBCLASS) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "bnode")).select(
        "artifact_id", local_name(F.col("s")).alias("cls"), F.col("o").alias("node")
    )
    rows = bounds.join(on, ["artifact_id", "node"]).join(users, ["artifact_id", "node"])
    cls, prop, n = F.col("cls"), F.col("prop"), F.col("n")
    few = F.least(n, F.lit(SPELLED))
    ys, more, zs = _numbered(few, "y"), _numbered(few + 1, "y"), _numbered(few + 1, "z")

    def at_least(names):
        return F.concat(
            F.lit("∃"), F.array_join(names, ","), F.lit(": "),
            F.array_join(F.concat(_related(prop, names), _compared(names, "≠")), " ∧ "),
        )

    def at_most(names):
        return F.concat(
            F.lit("∀"), F.array_join(names, ","), F.lit(": ("), F.array_join(_related(prop, names), " ∧ "),
            F.lit(") → ("), F.array_join(_compared(names, "="), " ∨ "), F.lit(")"),
        )

    has = F.concat(F.lit("∀x: "), cls, F.lit("(x) → "))
    nothing = F.concat(has, F.lit("¬∃y: "), prop, F.lit("(x,y)"))
    sign = F.when(F.col("kind") == "min", "≥").when(F.col("kind") == "max", "≤").otherwise("=")
    counted = F.concat(has, F.lit("∃"), sign, n.cast("string"), F.lit(" y: "), prop, F.lit("(x,y)"))
    fol = (
        F.when(n > SPELLED, counted)
        .when(F.col("kind") == "min", F.concat(has, at_least(ys)))
        .when(n == 0, nothing)
        .when(F.col("kind") == "max", F.concat(has, at_most(more)))
        .otherwise(F.concat(has, F.lit("("), at_least(ys), F.lit(" ∧ "), at_most(zs), F.lit(")")))
    )
    word = F.when(F.col("kind") == "min", "at least").when(F.col("kind") == "max", "at most").otherwise("exactly")
    return rows.where("kind <> 'min' OR n > 0").select(
        "artifact_id",
        F.concat(F.initcap("kind"), F.lit("Cardinality")).alias("premise_type"),
        fol.alias("fol"),
        F.concat_ws(" ", cls, F.lit("has"), word, n.cast("string"), prop, F.lit("relationships")).alias("description"),
    )


def axiom_premises(triples: DataFrame, ws: Workspace) -> DataFrame:
    """Premise rows (artifact_id, premise_type, fol, description) per axiom kind."""
    both = (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
    s, o = local_name(F.col("s")), local_name(F.col("o"))
    f = F.format_string
    objects = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.OBJECT_PROPERTY)).select("artifact_id", "s").distinct()

    def rows(df, kind, fol, text):
        return df.select(
            "artifact_id", F.lit(kind).alias("premise_type"), fol.alias("fol"), text.alias("description")
        )

    def of(p):
        return triples.where((F.col("p") == p) & both)

    def of_objects(cond):
        return triples.where(cond).join(objects, ["artifact_id", "s"], "left_semi")

    def marked(name):
        return of_objects((F.col("p") == S.TYPE) & (F.col("o") == S.owl(name + "Property")))

    parts = [
        rows(of(S.SUBCLASS), "SubClassOf", f("∀x,t: instance_of(x,%s,t) → instance_of(x,%s,t)", s, o),
             f("All instances of %s are also instances of %s", s, o)),
        rows(of_objects((F.col("p") == S.DOMAIN) & both), "PropertyDomain", f("∀x,y: %s(x,y) → %s(x)", s, o),
             f("If x relates to y via %s, then x is a %s", s, o)),
        rows(of_objects((F.col("p") == S.RANGE) & both), "PropertyRange", f("∀x,y: %s(x,y) → %s(y)", s, o),
             f("If x relates to y via %s, then y is a %s", s, o)),
        rows(marked("Transitive"), "Transitive", f("∀x,y,z: (%1$s(x,y) ∧ %1$s(y,z)) → %1$s(x,z)", s),
             f("Property %s is transitive", s)),
        rows(marked("Symmetric"), "Symmetric", f("∀x,y: %1$s(x,y) → %1$s(y,x)", s), f("Property %s is symmetric", s)),
        rows(marked("Functional"), "Functional", f("∀x,y,z: (%1$s(x,y) ∧ %1$s(x,z)) → y = z", s),
             f("Property %s is functional", s)),
        rows(of(S.EQUIVALENT), "EquivalentClasses", f("∀x: %s(x) ↔ %s(x)", s, o),
             f("A thing is a %s if and only if it is a %s", s, o)),
        cardinality_premises(triples),
    ]
    groups = sized(ws.table(disjoint_groups(triples, ws), "groups"))
    pairs = asserted_pairs(groups.where(F.col("size") <= PAIRED))
    turned = pairs.select("artifact_id", F.inline(F.array(
        F.struct(local_name(F.col("a")).alias("m"), local_name(F.col("b")).alias("n")),
        F.struct(local_name(F.col("b")).alias("m"), local_name(F.col("a")).alias("n")),
    )))
    parts.append(rows(turned, "DisjointClasses", f("∀x,t: ¬(instance_of(x,%s,t) ∧ instance_of(x,%s,t))", "m", "n"),
                      f("No instance can be both a %s and a %s", "m", "n")))
    long = groups.where(F.col("size") > PAIRED)
    if not long.isEmpty():  # a premise a member: it keeps off what the members before it come to
        placed = grouped_rank(long, ["artifact_id", "group_id"], ["member"], ws, "place")
        code = F.hex(F.xxhash64("group_id"))
        before, now = (F.concat(F.lit("g"), code, F.lit("_"), (F.col("place") - k).cast("string")) for k in (1, 0))
        name = local_name(F.col("member"))
        start = f("∀x,t: instance_of(x,%s,t) → one_of(x,%s,t)", name, now)
        rest = f("∀x,t: (instance_of(x,%1$s,t) → one_of(x,%3$s,t) ∧ ¬one_of(x,%2$s,t)) ∧ (one_of(x,%2$s,t) → one_of(x,%3$s,t))", name, before, now)
        parts.append(rows(placed, "DisjointClasses", F.when(F.col("place") == 1, start).otherwise(rest),
                          f("No instance of %s is one of the members listed before it", name)))
    chains = property_chains(triples, ws)
    link = F.struct("position", f("%s(x%s,x%s)", local_name(F.col("p")), F.col("position").cast("string"), (F.col("position") + 1).cast("string")).alias("text"))
    spelled = chains.groupBy("artifact_id", "chain", "q", "n").agg(F.array_sort(F.collect_list(link)).alias("links"))
    names = F.array_join(F.transform("links", lambda x: F.substring_index(x["text"], "(", 1)), " and then ")
    body = F.array_join(F.transform("links", lambda x: x["text"]), " ∧ ")
    q, end = local_name(F.col("q")), F.col("n").cast("string")
    several = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n")), lambda i: F.concat(F.lit("x"), i.cast("string"))), ",")
    parts.append(rows(spelled, "PropertyChain", f("∀%s: (%s) → %s(x0,x%s)", several, body, q, end),
                      f("Following %s leads along %s", names, q)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def mentioned_terms(premises: DataFrame) -> DataFrame:
    """Distinct lower-cased terms in the premises' formulas."""
    found = F.regexp_extract_all("fol", F.lit(PREMISE_TERM), F.lit(1))
    return premises.select("artifact_id", F.explode(F.transform(found, F.lower)).alias("term")).distinct()


def coverage(triples: DataFrame, premises: DataFrame) -> DataFrame:
    """Share of entities some premise mentions, case-insensitively, in percent."""
    wanted = entities(triples).where("kind <> 'annotation_property'").withColumn("term", F.lower("name"))
    hit = mentioned_terms(premises).withColumn("hit", F.lit(1))
    return (
        wanted.join(hit, ["artifact_id", "term"], "left")
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("total_elements"), F.count("hit").alias("covered_elements"))
        .withColumn("missing_elements", F.col("total_elements") - F.col("covered_elements"))
        .withColumn(
            "coverage_percentage", F.round(F.lit(100.0) * F.col("covered_elements") / F.col("total_elements"), 2)
        )
    )
