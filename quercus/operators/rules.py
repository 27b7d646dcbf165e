"""Entailment by rules: the part of OWL that joins can express.

Sound, not complete: results say what the rules found (``method = 'rules'``).
"""

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import is_upper, local_name, short_name
from quercus.operators.disjointness import list_members, property_chains
from quercus.operators.lint import straddle_pairs
from quercus.operators.normal_forms import ALL, SOME, VALUE, NormalForms, ancestors, expression_hierarchy, is_blank, normal_forms, saturated
from quercus.operators.ranking import first_per_group
from quercus.operators.walks import EDGE, Ancestors, ancestors_once, closure, propagate, subclass_edges
from quercus.sources.upper import Upper
from quercus.workspace import TASK_ROWS, Workspace, dealt

NOT_JUSTIFIED = "Unsatisfiable: equivalent to owl:Nothing under the asserted axioms."


def rule_edges(triples: DataFrame, ws: Workspace, base: DataFrame | None = None) -> DataFrame:
    """(artifact_id, child, parent, rule): subclass edges by class-level rules.

    scm-sco asserted edges, scm-eqc equivalence both ways, scm-int / scm-uni the
    named members of intersections and unions hung on a named class.
    """
    base = subclass_edges(triples) if base is None else base
    both_named = (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
    equal = triples.where((F.col("p") == S.EQUIVALENT) & both_named).select("artifact_id", "s", "o")
    turned = equal.select(
        "artifact_id",
        F.inline(F.array(
            F.struct(F.col("s").alias("child"), F.col("o").alias("parent")),
            F.struct(F.col("o").alias("child"), F.col("s").alias("parent")),
        )),
    )
    # named class -> blank expression node -> list head
    shape = F.col("p").isin(S.owl("intersectionOf"), S.owl("unionOf"))
    heads = triples.where(shape & (F.col("s_kind") == "bnode")).select(
        "artifact_id", F.col("s").alias("node"), F.col("o").alias("head"),
        F.when(F.col("p") == S.owl("unionOf"), "scm-uni").otherwise("scm-int").alias("rule"),
    )
    users = triples.where(
        F.col("p").isin(S.EQUIVALENT, S.SUBCLASS)
        & (F.col("s_kind") == "iri")
        & (F.col("o_kind") == "bnode")
    ).select("artifact_id", F.col("s").alias("named"), F.col("o").alias("node"), F.col("p").alias("via"))
    lists = (
        users.join(heads, ["artifact_id", "node"])
        .where((F.col("rule") == "scm-int") | (F.col("via") == S.EQUIVALENT))
        .select(
            "artifact_id", "head",
            F.concat_ws(" ", "rule", "named").alias("owner"),
        )
    )
    members = list_members(triples, lists, ws).where("member_kind = 'iri'")
    rule, named = F.substring_index("owner", " ", 1), F.substring_index("owner", " ", -1)
    expanded = members.select(
        "artifact_id",
        F.when(rule == "scm-uni", F.col("member")).otherwise(named).alias("child"),
        F.when(rule == "scm-uni", named).otherwise(F.col("member")).alias("parent"),
        rule.alias("rule"),
    )
    return (
        base.select(*EDGE, F.lit("scm-sco").alias("rule"))
        .union(turned.select(*EDGE, F.lit("scm-eqc").alias("rule")))
        .union(expanded)
        .where(F.col("child") != F.col("parent"))
        .groupBy(*EDGE)
        .agg(F.min("rule").alias("rule"))
    )


def class_hierarchy(triples: DataFrame, ws: Workspace) -> DataFrame:
    """Entailed subsumptions (artifact_id, child, ancestor), closed under the class rules."""
    return closure(rule_edges(triples, ws).select(*EDGE), ws).where("child <> ancestor")


def inferred_subsumptions(triples: DataFrame, ws: Workspace, hierarchy: DataFrame | None = None) -> DataFrame:
    """Entailed but not asserted subsumptions between named classes outside the upper ontology."""
    asserted = subclass_edges(triples).select("artifact_id", "child", F.col("parent").alias("ancestor"))
    hierarchy = class_hierarchy(triples, ws) if hierarchy is None else hierarchy.where("child <> ancestor")
    return (
        hierarchy.where(~is_upper(F.col("child")) & (F.col("ancestor") != S.THING))
        .join(asserted, ["artifact_id", "child", "ancestor"], "left_anti")
    )


def first_inferred(triples: DataFrame, limit: int, ws: Workspace) -> DataFrame:
    """(artifact_id, child, ancestor, total): the first rows of ``inferred_subsumptions`` of every artifact by child and ancestor, and the number of all.

    Only the first children that have any are spelled out, until they make ``limit`` rows; the others are counted.
    """
    said = subclass_edges(triples).where(~is_upper(F.col("child")) & (F.col("parent") != S.THING) & (F.col("child") != F.col("parent")))
    said = ws.table(said.select("artifact_id", "child", F.col("parent").alias("ancestor")), "said")
    closed = ancestors_once(rule_edges(triples, ws), ws)
    closed = Ancestors(closed.facts.where(F.col("ancestor") != S.THING), closed.members)
    less = said.groupBy("artifact_id", "child").agg(F.count(F.lit(1)).alias("less"))
    each = closed.counts().where(~is_upper(F.col("child"))).join(less, ["artifact_id", "child"], "left")
    each = each.select("artifact_id", "child", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0")
    each = ws.table(each, "inferred-counts")
    # a child has a row at least, so the first rows are those of as many children at most
    first = first_per_group(each, ["artifact_id"], ["child"], limit, ws)
    before = Window.partitionBy("artifact_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    shown = first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < limit).select("artifact_id", "child")
    rows = closed.rows(ws.table(shown, "inferred-children")).join(said, ["artifact_id", "child", "ancestor"], "left_anti")
    top = first_per_group(rows, ["artifact_id"], ["child", "ancestor"], limit, ws).drop("rn")
    return top.join(each.groupBy("artifact_id").agg(F.sum("n").alias("total")), "artifact_id").select("artifact_id", "child", "ancestor", "total")


def unsatisfiable_classes(
    triples: DataFrame, upper: Upper, ws: Workspace, base: DataFrame | Callable | None = None, forms: NormalForms | None = None
) -> DataFrame:
    """(artifact_id, cls, reason): classes that no individual can belong to.

    On the saturated normal forms (``normal_forms``): a node is empty when it falls under both sides of an upper
    disjointness, under two members of an asserted disjoint group, under a class and its complement, or under owl:Nothing.
    What lies under an empty node is empty, and so is what requires a link to one, and a union of nothing but empty
    nodes.  ``base`` stands for the named subclass edges, if they are not the artifact's own only, or is a function that
    makes them; ``forms`` are normal forms to be reused.
    """
    forms = forms or normal_forms(triples, ws, base)
    tops = forms.told.where(is_upper(F.col("parent")) | (F.col("parent") == S.NOTHING)).select("artifact_id", F.col("parent").alias("value"))
    also = tops.union(forms.apart.select("artifact_id", "member"))
    edges, facts = saturated(forms, ws, also)
    under_upper = facts.where(is_upper(F.col("value"))).select("artifact_id", F.col("node").alias("cls"), F.col("value").alias("upper_iri"))
    clash = straddle_pairs(under_upper, upper).select("artifact_id", "cls", F.lit("upper").alias("reason"))
    own = (
        facts.join(forms.apart.withColumnRenamed("member", "value"), ["artifact_id", "value"])
        .groupBy("artifact_id", F.col("node").alias("cls"), "group_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("artifact_id", "cls", F.lit("asserted").alias("reason"))
    )
    nothing = facts.where(F.col("value") == S.NOTHING).select("artifact_id", F.col("node").alias("cls"), F.lit("asserted").alias("reason"))
    reasons = clash.union(own).union(nothing).groupBy("artifact_id", "cls").agg(F.max("reason").alias("reason"))
    if not forms.rows["some"] + forms.rows["joins"]:
        return _shown(reasons)
    if forms.rows["joins"]:
        return _shown(_spread_by_unions(ws.table(reasons, "direct"), edges, forms, ws))
    done = ws.beside(direct=lambda: ws.table(reasons, "direct"), links=lambda: _carriers(forms, facts, ws))
    return _shown(_spread(done["direct"], done["links"], forms, facts, ws))


def _shown(empty: DataFrame) -> DataFrame:
    return empty.where(~is_upper(F.col("cls")) & ~is_blank(F.col("cls")) & (F.col("cls") != S.NOTHING))


def _carriers(forms: NormalForms, facts: DataFrame, ws: Workspace):
    """(path, rows) of the links (artifact_id, child, parent) between ∃-nodes: a child is empty if its parent is.

    Only these pass emptiness on to what is not empty already: whatever lies under a directly empty node lies under the same
    clash. ∃-nodes hand it on by their targets too.
    """
    nodes = forms.some.select("artifact_id", F.col("node").alias("parent")).distinct()
    under = facts.withColumnRenamed("value", "parent").join(nodes, ["artifact_id", "parent"], "left_semi")
    lower = forms.some.select("artifact_id", F.col("node").alias("child"), F.explode(F.array("node", "target")).alias("node"))
    links = under.join(lower, ["artifact_id", "node"]).select(*EDGE).where("child <> parent").distinct()
    return ws.write(links, "carriers")


def _spread(direct: DataFrame, links, forms: NormalForms, facts: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, cls, reason): ``direct`` and what else is empty without unions: what needs a link to an empty class."""
    path, n_links = links
    graph = direct.sparkSession.read.schema("artifact_id string, child string, parent string").parquet(path)
    none = F.lit(None).cast("string")
    first = forms.some.select("artifact_id", F.col("target").alias("cls"), "node").join(direct, ["artifact_id", "cls"], "left_semi")
    seeds = first.select("artifact_id", F.col("node").alias("value")).distinct()
    if n_links:
        given = seeds.select("artifact_id", F.col("value").alias("child"), none.alias("parent"), F.lit("x").alias("value"))
        seeds = propagate(graph.withColumn("value", none).union(given), ws).select("artifact_id", F.col("node").alias("value"))
    return _inherited(direct, facts.join(seeds, ["artifact_id", "value"], "left_semi").select("artifact_id", F.col("node").alias("cls")).distinct())


def _inherited(direct: DataFrame, spread: DataFrame) -> DataFrame:
    key = ["artifact_id", "cls"]
    return direct.join(spread.withColumn("spread", F.lit(True)), key, "full").select(*key, F.coalesce("reason", F.lit("inherited")).alias("reason"))


def _spread_by_unions(direct: DataFrame, edges: DataFrame, forms: NormalForms, ws: Workspace) -> DataFrame:
    """(artifact_id, cls, reason): ``direct`` and what else is empty: what needs a link to an empty class, and unions of nothing but empty ones.

    A class may lie under any number of unions, nearly all of which are not empty, so what lies under each of them is not spelled out:
    emptiness is one fact that walks down the edges, and from targets to their ∃-nodes, again for what new empty unions bring.
    """
    spark, key = direct.sparkSession, ["artifact_id", "cls"]
    none = F.lit(None).cast("string")
    graph = edges.union(forms.some.select("artifact_id", "node", "target")).withColumn("value", none)
    walked, empty, seeds = not forms.rows["some"], direct, direct.select(*key)
    while True:
        gone = forms.joins.join(empty.withColumnRenamed("cls", "member"), ["artifact_id", "member"], "left_semi")
        whole = gone.groupBy("artifact_id", F.col("node").alias("cls"), "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
        path, n = ws.write(whole.select(*key).join(empty, key, "left_anti"), "empty-unions")
        if n == 0 and walked:
            return empty
        if n:
            seeds = seeds.union(spark.read.schema("artifact_id string, cls string").parquet(path))
        given = seeds.select("artifact_id", F.col("cls").alias("child"), none.alias("parent"), F.lit("x").alias("value"))
        spread = propagate(graph.union(given), ws).select("artifact_id", F.col("node").alias("cls"))
        walked, empty = True, ws.table(_inherited(direct, spread), "empty")


def justified(unsat: DataFrame, findings: DataFrame) -> DataFrame:
    """Attach a lint message to each unsatisfiable class, by name, or a stock text."""
    texts = findings.groupBy("artifact_id", F.col("class_name").alias("name")).agg(
        F.max_by("message", F.concat_ws(" ", "class_iri", "category_a_iri", "category_b_iri")).alias("text")
    )
    return (
        unsat.withColumn("name", short_name(F.col("cls")))
        .join(texts, ["artifact_id", "name"], "left")
        .select("artifact_id", "cls", "name", F.coalesce("text", F.lit(NOT_JUSTIFIED)).alias("justification"))
    )


# -- individuals -----------------------------------------------------------

#: Rules of assertions and types, the one that is told first: an expression's own rule tells more than the hierarchy, an assertion more than both.
RULES = [
    "asserted", "cls-hv2", "cls-int1", "cls-svf1", "cls-svf2", "cax-sco", "prp-dom", "prp-inv", "prp-rng", "prp-spo1", "prp-spo2", "prp-trp",
]


def _told_first(rows: DataFrame, key: list, pick=F.min) -> DataFrame:
    """(key, rule): a rule per key, picked by its place in ``RULES``; the least or greatest of numbers is hashed, of texts it is sorted."""
    names = F.array(*map(F.lit, RULES))
    picked = rows.groupBy(*key).agg(pick(F.array_position(names, F.col("rule")).cast("int")).alias("place"))
    return picked.select(*key, F.element_at(names, F.col("place")).alias("rule"))


def property_paths(triples: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, p, q, flip): a p-assertion entails a q-assertion, turned round when flip.

    Closed over subPropertyOf, equivalentProperty, inverseOf and symmetry.  Each
    property is walked in two senses, '+' and '-'.
    """
    tbox = triples.where(
        F.col("p").isin(S.SUBPROPERTY, S.owl("equivalentProperty"), S.owl("inverseOf"))
        & (F.col("s_kind") == "iri")
        & (F.col("o_kind") == "iri")
    )
    straight = tbox.where(F.col("p") != S.owl("inverseOf")).select("artifact_id", "s", "o", F.lit(False).alias("flip"))
    back = tbox.where(F.col("p") == S.owl("equivalentProperty")).select(
        "artifact_id", F.col("o").alias("s"), F.col("s").alias("o"), F.lit(False).alias("flip")
    )
    inverse = tbox.where(F.col("p") == S.owl("inverseOf"))
    turned = inverse.select("artifact_id", "s", "o", F.lit(True).alias("flip")).union(
        inverse.select("artifact_id", F.col("o"), F.col("s"), F.lit(True))
    )
    symmetric = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("SymmetricProperty"))).select(
        "artifact_id", "s", F.col("s").alias("o"), F.lit(True).alias("flip")
    )
    arrows = straight.union(back).union(turned).union(symmetric)
    other = F.when(F.col("flip"), F.when(F.col("sense") == "+", "-").otherwise("+")).otherwise(F.col("sense"))
    edges = arrows.select("artifact_id", "s", "o", "flip", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("sense")).select(
        "artifact_id",
        F.concat_ws(" ", "sense", "s").alias("child"),
        F.concat_ws(" ", other, "o").alias("parent"),
    )
    reached = closure(edges.distinct(), ws).where(F.col("child").startswith("+"))
    return reached.select(
        "artifact_id",
        F.substring_index("child", " ", -1).alias("p"),
        F.substring_index("ancestor", " ", -1).alias("q"),
        F.col("ancestor").startswith("-").alias("flip"),
    ).where("flip OR p <> q")


def assertions(triples: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Property assertions between named things, on declared object properties; a workspace gets these, a small table, written first."""
    props = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.OBJECT_PROPERTY)).select(
        "artifact_id", F.col("s").alias("p")
    )
    if ws is not None:
        props = ws.table(props.distinct(), "object-properties")
    named = triples.where(
        (F.col("s_kind") == "iri")
        & (F.col("o_kind") == "iri")
        & ~F.col("p").startswith(S.RDF)
        & ~F.col("p").startswith(S.RDFS)
        & ~F.col("p").startswith(S.OWL)
    )
    return named.join(props.distinct(), ["artifact_id", "p"], "left_semi").select("artifact_id", "s", "p", "o")


def _rewritten(df: DataFrame, paths: DataFrame) -> DataFrame:
    """(artifact_id, s, p, o, rule): what sub-, equivalent, inverse and symmetric properties make of assertions."""
    return df.join(paths, ["artifact_id", "p"]).select(
        "artifact_id",
        F.when(F.col("flip"), F.col("o")).otherwise(F.col("s")).alias("s"),
        F.col("q").alias("p"),
        F.when(F.col("flip"), F.col("s")).otherwise(F.col("o")).alias("o"),
        F.when(F.col("flip"), "prp-inv").otherwise("prp-spo1").alias("rule"),
    )


def telling_properties(triples: DataFrame) -> DataFrame:
    """(artifact_id, p): the properties that say something of what they link, by domain, range or a restriction."""
    scoped = triples.where(F.col("p").isin(S.DOMAIN, S.RANGE)).select("artifact_id", F.col("s").alias("p"))
    return scoped.union(triples.where(F.col("p") == S.owl("onProperty")).select("artifact_id", "o")).distinct()


def links_of(triples: DataFrame, asked: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, s, p, o): the entailed assertions of the asked properties (artifact_id, p); a row may come more than once.

    Where no property is transitive or made of a chain, assertions of other properties are not made, and nothing is shuffled to tell repeated rows.
    """
    key = ["artifact_id", "s", "p", "o"]
    grows = ((F.col("p") == S.TYPE) & (F.col("o") == S.owl("TransitiveProperty"))) | (F.col("p") == S.owl("propertyChainAxiom"))
    asked = ws.table(asked, "asked-properties")
    if not triples.where(grows).isEmpty():
        return entailed_assertions(triples, ws).join(asked, ["artifact_id", "p"], "left_semi").select(*key)
    paths = property_paths(triples, ws).join(asked.withColumnRenamed("p", "q"), ["artifact_id", "q"], "left_semi")
    paths, n = ws.sized_tables(paths=paths)["paths"]
    base = assertions(triples, ws)
    told = base.join(asked, ["artifact_id", "p"], "left_semi").select(*key)
    return told.union(_rewritten(base, paths).select(*key)) if n else told


def entailed_assertions(triples: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, s, p, o, rule): asserted and entailed property assertions.

    Property-level rules are closed first (a small table), so sub-, equivalent,
    inverse and symmetric properties cost one join.  Transitive properties are
    closed by the walk (prp-trp), property chains of any length are composed link by link (prp-spo2),
    and their new facts go through the property rules again until nothing changes.
    """
    spark = triples.sparkSession
    paths = ws.table(property_paths(triples, ws), "property-paths")
    transitive = ws.table(
        triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("TransitiveProperty")))
        .select("artifact_id", F.col("s").alias("p"))
        .distinct(),
        "transitive",
    )
    linked = triples.where(F.col("p") == S.owl("propertyChainAxiom"))
    chains = None if linked.isEmpty() else ws.table(property_chains(triples, ws), "chains")
    key = ["artifact_id", "s", "p", "o"]
    base = assertions(triples, ws)

    def rewrite(df):
        return _rewritten(df, paths)

    def closed(known):
        links = known.join(transitive, ["artifact_id", "p"]).select(
            "artifact_id",
            F.concat_ws(" ", "p", "s").alias("child"),
            F.concat_ws(" ", "p", "o").alias("parent"),
            F.concat_ws(" ", "p", "o").alias("value"),
        )
        return propagate(links, ws).select(
            "artifact_id",
            F.substring_index("node", " ", -1).alias("s"),
            F.substring_index("node", " ", 1).alias("p"),
            F.substring_index("value", " ", -1).alias("o"),
            F.lit("prp-trp").alias("rule"),
        )

    first = base.withColumn("rule", F.lit("asserted")).union(rewrite(base))
    rows = triples.count()
    if rows > TASK_ROWS:
        first = dealt(first, 2 * rows, *key)
    first = _told_first(first, key)
    walked = not transitive.isEmpty()
    if not walked and chains is None:
        return first
    known = ws.table(first, "assertions")
    while True:
        new = [closed(known)] if walked else []
        if chains is not None:
            new.append(composed(known, chains, ws))
        found = new[0].union(new[1]) if len(new) > 1 else new[0]
        grown = _told_first(found.union(rewrite(found.select(*key))), key, F.max)
        path, n = ws.write(grown.join(known, key, "left_anti"), "assertions")
        if n == 0:
            return known
        fresh = spark.read.schema(known.schema).parquet(path)
        known = known.union(fresh.select(known.columns))


def composed(known: DataFrame, chains: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, s, p, o, rule): what property chains make of the known assertions, a link more in every round."""
    spark = known.sparkSession
    schema = "artifact_id string, chain string, s string, o string"
    step = chains.select("artifact_id", "chain", "position", "p")
    hops = known.select("artifact_id", "p", F.col("s").alias("o"), F.col("o").alias("next"))
    reached = known.join(step.where("position = 0"), ["artifact_id", "p"]).select("artifact_id", "chain", "s", "o").distinct()
    done, position = [], 0
    while True:
        path, n = ws.write(reached, "composed")
        if n == 0:
            break
        position += 1
        reached = spark.read.schema(schema).parquet(path)
        ends = chains.where((F.col("position") == 0) & (F.col("n") == position)).select("artifact_id", "chain", "q")
        done.append(reached.join(ends, ["artifact_id", "chain"]).select("artifact_id", "s", F.col("q").alias("p"), "o"))
        onward = reached.join(step.where(F.col("position") == position), ["artifact_id", "chain"])
        reached = onward.join(hops, ["artifact_id", "p", "o"]).select("artifact_id", "chain", "s", F.col("next").alias("o")).distinct()
    out = known.select("artifact_id", "s", "p", "o").limit(0)
    for part in done:
        out = out.union(part)
    return out.distinct().withColumn("rule", F.lit("prp-spo2"))


def entailed_types(
    triples: DataFrame, ws: Workspace, properties: DataFrame | None = None, reasoned=None, wanted: DataFrame | None = None
) -> DataFrame:
    """(artifact_id, ind, cls, rule): asserted and entailed types of named individuals.

    On the normal forms: cax-sco through the saturated hierarchy of classes and expressions, prp-dom / prp-rng on entailed
    assertions of the properties that tell anything, cls-svf1 and cls-hv2 where an assertion leads into
    a filler or to a value, whichever side of an axiom the expression stands on, and cls-int1 for individuals
    in all members of an intersection. Only what is new goes round again.

    ``reasoned`` is an ``expression_hierarchy`` to be reused. With ``wanted`` (artifact_id, cls) only types among these come
    back, expressions included, and others are not carried along; without, all named classes.
    """
    begun = ws.beside(
        reasoned=lambda: reasoned or expression_hierarchy(triples, ws),
        props=lambda: links_of(triples, telling_properties(triples), ws) if properties is None else properties,
    )
    (forms, edges, hierarchy), props = begun["reasoned"], begun["props"]
    declared = triples.where((F.col("p") == S.TYPE) & (F.col("s_kind") == "iri") & F.col("o_kind").isin("iri", "bnode"))
    own = declared.where(
        ~F.col("o").startswith(S.OWL) & ~F.col("o").startswith(S.RDFS)
    ).select("artifact_id", F.col("s").alias("ind"), F.col("o").alias("cls"), F.lit("asserted").alias("rule"))
    some = forms.some.where("p <> ''").select("artifact_id", "p", "filler", F.col("node").alias("result"))
    scope = triples.where(F.col("p").isin(S.DOMAIN, S.RANGE) & F.col("o_kind").isin("iri", "bnode")).select(
        "artifact_id", F.col("s").alias("p"), F.col("o").alias("cls"), (F.col("p") == S.DOMAIN).alias("domain"),
        F.when(F.col("p") == S.DOMAIN, "prp-dom").otherwise("prp-rng").alias("rule"),
    )
    # whatever a link leads to is a thing
    anything = some.where(F.col("filler") == S.THING).select("artifact_id", "p", "result", F.lit(True), F.lit("cls-svf2"))
    ends = props.select(
        "artifact_id", "p",
        F.inline(F.array(
            F.struct(F.col("s").alias("ind"), F.lit(True).alias("domain")),
            F.struct(F.col("o").alias("ind"), F.lit(False).alias("domain")),
        )),
    )
    # a written table of its size, so that links, which are many, need not be shuffled to meet it
    scope = ws.table(scope.union(anything).distinct(), "scope")
    scoped = ends.join(scope, ["artifact_id", "p", "domain"]).select("artifact_id", "ind", "cls", "rule")
    # a type that an expression brings with its axiom keeps the expression's rule
    step = forms.told.where(is_blank(F.col("child"))).select("artifact_id", F.col("child").alias("cls"), F.col("parent").alias("ancestor"))
    spelled = step.where(F.col("cls").startswith(SOME) | F.col("cls").startswith(ALL)).withColumnRenamed("ancestor", "node")
    beyond = spelled.join(step.withColumnRenamed("cls", "node"), ["artifact_id", "node"]).select("artifact_id", "cls", "ancestor")
    said = step.union(beyond).distinct().withColumn("said", F.lit(True))
    above = hierarchy.where("child <> ancestor").select("artifact_id", F.col("child").alias("cls"), "ancestor").join(
        said, ["artifact_id", "cls", "ancestor"], "left"
    )
    carried = None
    if wanted is not None:
        carried = ws.table(wanted.union(forms.asked()).distinct(), "wanted").toDF("artifact_id", "cls")
        above = above.join(carried.withColumnRenamed("cls", "ancestor"), ["artifact_id", "ancestor"], "left_semi")
    above = ws.table(above.select("artifact_id", "cls", "ancestor", "said"), "above")
    key = ["artifact_id", "ind", "cls"]

    def lifted(direct):
        up = direct.join(above, ["artifact_id", "cls"]).select(
            "artifact_id", "ind", F.col("ancestor").alias("cls"),
            F.when(F.col("said") & F.col("rule").startswith("cls-"), F.col("rule")).otherwise("cax-sco").alias("rule"),
        )
        if carried is not None:
            direct = direct.join(carried, ["artifact_id", "cls"], "left_semi").select(*key, "rule")
        return _told_first(direct.union(up), key)

    def told(types):
        if wanted is None:
            return types.where(~is_blank(F.col("cls")) & (F.col("cls") != S.THING))
        return types.join(wanted, ["artifact_id", "cls"], "left_semi").select(*key, "rule")

    has = some.where(F.col("filler").startswith(VALUE))
    by_value = props.join(has, ["artifact_id", "p"]).where(F.concat(F.lit(VALUE), "o") == F.col("filler")).select(
        "artifact_id", F.col("s").alias("ind"), F.col("result").alias("cls"), F.lit("cls-hv2").alias("rule")
    )
    first = lifted(own.union(scoped).union(by_value))
    if not forms.rows["some"] + forms.rows["meets"]:
        return told(first)
    # a new type may be the filler or the member that another expression waits for; links meet the fillers that their objects are of,
    # as links of a property times its fillers grow with the square of the input
    linked = ws.table(props.join(some.select("artifact_id", "p").distinct(), ["artifact_id", "p"], "left_semi").select("artifact_id", "s", "p", "o"), "restricted")
    fillers = some.select("artifact_id", F.col("filler").alias("cls")).distinct()
    meets = forms.meets.select("artifact_id", F.col("member").alias("cls"), F.col("node").alias("whole"), "n")
    known = delta = ws.table(first, "types")
    while True:
        filling = delta.join(fillers, ["artifact_id", "cls"], "left_semi").select("artifact_id", F.col("ind").alias("o"), F.col("cls").alias("filler"))
        hit = linked.join(filling, ["artifact_id", "o"]).join(some, ["artifact_id", "p", "filler"]).select(
            "artifact_id", F.col("s").alias("ind"), F.col("result").alias("cls"), F.lit("cls-svf1").alias("rule")
        )
        touched = delta.join(meets, ["artifact_id", "cls"]).select("artifact_id", "ind", "whole").distinct()
        met = known.join(meets, ["artifact_id", "cls"]).join(touched, ["artifact_id", "ind", "whole"], "left_semi")
        met = met.groupBy("artifact_id", "ind", F.col("whole").alias("cls"), "n").agg(F.count(F.lit(1)).alias("m")).where("m = n")
        found = hit.distinct().union(met.select(*key, F.lit("cls-int1")))
        path, n = ws.write(lifted(found).join(known, key, "left_anti"), "types")
        if n == 0:
            return told(known)
        delta = triples.sparkSession.read.schema(known.schema).parquet(path)
        known = known.union(delta.select(known.columns))


def inconsistent_individuals(triples: DataFrame, upper: Upper, ws: Workspace, forms: NormalForms | None = None) -> DataFrame:
    """(artifact_id, ind, rule): individuals the rules find contradictory.

    cax-dw: typed to both sides of a disjointness, upper or asserted; cls-com: to a class and its complement;
    cls-nothing2: to owl:Nothing; prp-irp / prp-asyp: irreflexive and asymmetric properties. Only types that can clash are carried.
    ``forms`` are normal forms to be reused.
    """

    def hierarchy_edges():
        made = forms or normal_forms(triples, ws)
        return made, saturated(made, ws)[0]

    # properties that say nothing of what they link need no assertions
    typed = triples.where((F.col("p") == S.TYPE) & F.col("o").isin(S.owl("IrreflexiveProperty"), S.owl("AsymmetricProperty")))
    telling = telling_properties(triples).union(typed.select("artifact_id", F.col("s").alias("p"))).distinct()

    def assertions_that_tell():
        return ws.table(links_of(triples, telling, ws), "entailed-assertions")

    begun = ws.beside(props=assertions_that_tell, edges=hierarchy_edges)
    props, (forms, edges) = begun["props"], begun["edges"]
    nodes = edges.select("artifact_id", F.col("parent").alias("cls")).union(
        triples.where((F.col("p") == S.TYPE) | F.col("p").isin(S.DOMAIN, S.RANGE)).select("artifact_id", "o")
    )
    tops = nodes.where(is_upper(F.col("cls")) | (F.col("cls") == S.NOTHING))
    wanted = ws.table(tops.union(forms.apart.select("artifact_id", "member")).distinct(), "clashing")
    asked = wanted.toDF("artifact_id", "value").union(forms.asked())
    hierarchy = ws.table(ancestors(edges, asked, ws), "hierarchy")
    types = ws.table(
        entailed_types(triples, ws, props, (forms, edges, hierarchy), wanted).select("artifact_id", "ind", "cls"), "entailed-types"
    )
    under = types.where(is_upper(F.col("cls"))).select(
        "artifact_id", F.col("ind").alias("cls"), F.col("cls").alias("upper_iri")
    )
    by_upper = straddle_pairs(under, upper).select("artifact_id", F.col("cls").alias("ind"), F.lit("cax-dw").alias("rule"))
    by_group = (
        types.join(forms.apart.withColumnRenamed("member", "cls"), ["artifact_id", "cls"])
        .groupBy("artifact_id", "ind", "group_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("artifact_id", "ind", F.when(F.col("group_id").startswith("not "), "cls-com").otherwise("cax-dw").alias("rule"))
    )
    by_nothing = types.where(F.col("cls") == S.NOTHING).select("artifact_id", "ind", F.lit("cls-nothing2").alias("rule"))

    def marked(kind):
        return triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl(kind))).select(
            "artifact_id", F.col("s").alias("p")
        )

    loops = props.where("s = o").join(
        marked("IrreflexiveProperty"), ["artifact_id", "p"], "left_semi"
    ).select("artifact_id", F.col("s").alias("ind"), F.lit("prp-irp").alias("rule"))
    asym = props.join(marked("AsymmetricProperty"), ["artifact_id", "p"], "left_semi")
    both = asym.join(
        asym.select("artifact_id", "p", F.col("o").alias("s"), F.col("s").alias("o")),
        ["artifact_id", "p", "s", "o"], "left_semi",
    ).select("artifact_id", F.col("s").alias("ind"), F.lit("prp-asyp").alias("rule"))
    return by_upper.union(by_group).union(by_nothing).union(loops).union(both).distinct()


def coherence(artifacts: DataFrame, unsat: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """inconsistent > incoherent > coherent, per artifact (rules always run, so never unknown)."""
    bad = inconsistent.groupBy("artifact_id").agg(F.countDistinct("ind").alias("inconsistent_individuals"))
    empty = unsat.groupBy("artifact_id").agg(F.countDistinct("cls").alias("unsatisfiable_classes"))
    zero = F.lit(0).cast("bigint")
    out = artifacts.join(bad, "artifact_id", "left").join(empty, "artifact_id", "left")
    return out.select(
        "artifact_id",
        F.coalesce("inconsistent_individuals", zero).alias("inconsistent_individuals"),
        F.coalesce("unsatisfiable_classes", zero).alias("unsatisfiable_classes"),
        F.when(F.coalesce("inconsistent_individuals", zero) > 0, "inconsistent")
        .when(F.coalesce("unsatisfiable_classes", zero) > 0, "incoherent")
        .otherwise("coherent")
        .alias("coherence_status"),
        F.lit("rules").alias("method"),
    )


def inferred_equivalences(triples: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(artifact_id, child, ancestor), child < ancestor: classes that subsume each other without saying so."""
    back = hierarchy.select("artifact_id", F.col("ancestor").alias("child"), F.col("child").alias("ancestor"))
    key = ["artifact_id", "child", "ancestor"]
    said = triples.where((F.col("p") == S.EQUIVALENT) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(
        "artifact_id", F.least("s", "o").alias("child"), F.greatest("s", "o").alias("ancestor")
    )
    return hierarchy.where("child < ancestor").join(back, key, "left_semi").join(said, key, "left_anti").select(*key)


def derivations(inferred: DataFrame, equivalences: DataFrame, ruled: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """A derivation row per inferred axiom, with the rule of its last step and the facts that step rests on.

    ``ruled(artifact_id, child, parent, rule)`` are the rule edges, ``hierarchy`` their closure.
    Of several last steps the one over the smallest IRI is told.
    """
    name = {k: local_name(F.col(k)) for k in ("child", "ancestor", "via")}
    steps = ruled.select("artifact_id", F.col("child").alias("via"), F.col("parent").alias("ancestor"), "rule")
    loops = steps.select("artifact_id", F.col("via").alias("child"), "via").distinct()
    reached = hierarchy.select("artifact_id", "child", F.col("ancestor").alias("via")).union(loops).distinct()
    last = (
        reached.join(steps, ["artifact_id", "via"])
        .groupBy("artifact_id", "child", "ancestor")
        .agg(F.min(F.struct("via", "rule")).alias("last"))
    )
    told = inferred.join(last, ["artifact_id", "child", "ancestor"], "left").select(
        "artifact_id", "child", "ancestor", F.col("last.via").alias("via"), F.col("last.rule").alias("rule")
    )
    step = F.concat(name["via"], F.lit(" ⊑ "), name["ancestor"])
    through = F.concat(name["child"], F.lit(" ⊑ "), name["via"], F.lit("; "))
    subsumed = told.select(
        "artifact_id", F.lit("SubClassOf").alias("axiom_type"),
        F.concat(name["child"], F.lit(" ⊑ "), name["ancestor"]).alias("description"), "rule",
        F.concat(F.when(F.col("via") != F.col("child"), through).otherwise(""), step).alias("supporting_facts"),
        F.lit("rules").alias("origin"), "child", "ancestor",
    )
    both = F.concat(name["child"], F.lit(" ⊑ "), name["ancestor"], F.lit("; "), name["ancestor"], F.lit(" ⊑ "), name["child"])
    equal = equivalences.select(
        "artifact_id", F.lit("EquivalentClass").alias("axiom_type"),
        F.concat(name["child"], F.lit(" ≡ "), name["ancestor"]).alias("description"), F.lit("scm-eqc2").alias("rule"),
        both.alias("supporting_facts"), F.lit("rules").alias("origin"), "child", "ancestor",
    )
    return subsumed.union(equal)
