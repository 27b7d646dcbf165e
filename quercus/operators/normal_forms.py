"""Class expressions in normal form, and the subsumptions that follow from them.

Every class expression (a blank node, or a named class that carries the construct itself) is a node next to the named
classes, and an ontology becomes four kinds of rows:

* ``told``  child ⊑ parent, between nodes of any kind,
* ``meets`` a node is the intersection of its members, with their number,
* ``some``  a node is ∃ property . filler,
* ``apart`` the members of a group are pairwise disjoint; a complement and what it negates are such a group.

A ∃-node also has a *target*, the class of the things its links lead to: it lies under the filler and the property's ranges,
while the node itself lies under the property's domains (over sub-, equivalent, inverse and symmetric properties).
Saturation then only has to add edges between nodes, in a loop that ends when none is new: a node under all
members of an intersection lies under it; ∃ p . A lies under ∃ q . B if p is a q and the target of the first lies under
B; and if the target lies under a ∃-node of the same transitive property, the node does too. What a node lies under is found by
``walks.propagate``, which only carries the nodes that rules ask about.

Sound, and complete for what the rows say (the part of OWL 2 EL without nominals that are compared, plus disjointness,
inverses and symmetry of properties as far as domains and ranges go); unions and cardinalities only in the
directions that rows can say: members lie under their union, and at least one of a thing is some of it.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.operators.disjointness import list_members
from quercus.operators.walks import EDGE, propagate, subclass_edges
from quercus.workspace import Workspace

NODE = ("iri", "bnode")
#: Nodes of our own making; they start like blank nodes, so no result shows them. Those that stand for expressions of like
#: meaning are smaller than these, so the expressions are a star around them from the start when a walk condenses equals.
SOME, TARGET, VALUE, LEAST, ALL = "_: some ", "_:to ", "_:is ", "_:min ", "_: all "
AT_LEAST = ("minCardinality", "cardinality", "minQualifiedCardinality", "qualifiedCardinality")


@dataclass
class NormalForms:
    told: DataFrame  # artifact_id, child, parent
    meets: DataFrame  # artifact_id, node, member, n
    joins: DataFrame  # artifact_id, node, member, n: the node is the union of its members
    some: DataFrame  # artifact_id, node, p, filler, target
    apart: DataFrame  # artifact_id, group_id, member
    roles: DataFrame  # artifact_id, p, q: every p-link is a q-link, reflexive over the properties in use
    transitive: DataFrame  # artifact_id, p
    rows: dict  # how many rows each of these has, by name

    def asked(self) -> DataFrame:
        """(artifact_id, value): the nodes that rules ask about."""
        rows = [self.meets.select("artifact_id", "member"), self.meets.select("artifact_id", "node")]
        rows += [self.some.select("artifact_id", "filler"), self.some.select("artifact_id", "node")]
        return _all(rows).toDF("artifact_id", "value").distinct()


def _all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _links(triples: DataFrame, *names: str) -> DataFrame:
    """(artifact_id, node, p, value) of a construct, by its properties."""
    return triples.where(F.col("p").isin(*[S.owl(n) for n in names]) & F.col("s_kind").isin(*NODE)).select(
        "artifact_id", F.col("s").alias("node"), "p", F.col("o").alias("value"), "o_kind", "o_datatype"
    )


def is_blank(column):
    return column.startswith("_:")


def normal_forms(triples: DataFrame, ws: Workspace, base: DataFrame | Callable | None = None) -> NormalForms:
    """The rows of every artifact; ``base`` stands for the named subclass edges (with a kernel's, say), or is a function that makes them."""
    from quercus.operators.rules import property_paths

    nodes = F.col("s_kind").isin(*NODE) & F.col("o_kind").isin(*NODE)
    axioms = triples.where(F.col("p").isin(S.SUBCLASS, S.EQUIVALENT, S.DISJOINT, S.owl("complementOf")) & nodes)
    down = axioms.where(F.col("p").isin(S.SUBCLASS, S.EQUIVALENT)).select("artifact_id", "s", "o")
    up = axioms.where(F.col("p") == S.EQUIVALENT).select("artifact_id", "o", "s")
    pair = F.when(F.col("p") == S.DISJOINT, F.concat_ws(" ", F.least("s", "o"), F.greatest("s", "o"))).otherwise(F.concat_ws(" ", F.lit("not"), "s", "o"))
    pairs = axioms.where(F.col("p").isin(S.DISJOINT, S.owl("complementOf"))).select(
        "artifact_id", pair.alias("group_id"), F.explode(F.array("s", "o")).alias("member")
    )

    # all lists in one doubling
    lists = _links(triples, "intersectionOf", "unionOf", "disjointUnionOf", "members").where(F.col("o_kind").isin(*NODE))
    groups = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("AllDisjointClasses"))).select("artifact_id", F.col("s").alias("node"))
    lists = lists.where(F.col("p") != S.owl("members")).unionByName(
        lists.where(F.col("p") == S.owl("members")).join(groups.distinct(), ["artifact_id", "node"], "left_semi").select(lists.columns)
    )
    owner = F.concat_ws(" ", F.substring_index("p", "#", -1), "node")

    def spelled_out():
        heads = lists.select("artifact_id", owner.alias("owner"), F.col("value").alias("head"))
        listed = list_members(triples, heads, ws).where(F.col("member_kind").isin(*NODE))
        kind, node = F.substring_index("owner", " ", 1), F.substring_index("owner", " ", -1)
        return _counted(listed.select("artifact_id", kind.alias("kind"), node.alias("node"), "member").distinct(), "listed", ws, meets="kind = 'intersectionOf'", joins="kind IN ('unionOf', 'disjointUnionOf')")

    shape = _links(triples, "onProperty", "someValuesFrom", "hasValue", "onClass", *AT_LEAST)
    least = ", ".join(f"'{S.owl(n)}'" for n in AT_LEAST)
    transitive = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("TransitiveProperty"))).select("artifact_id", F.col("s").alias("p"))
    begun = ws.beside(
        listed=spelled_out, paths=lambda: ws.table(property_paths(triples, ws), "paths"),
        shape=lambda: _counted(shape, "shape", ws, least=f"p IN ({least})"),
        transitive=lambda: ws.sized_tables(transitive=transitive.distinct())["transitive"],
        base=lambda: base() if callable(base) else base,
    )
    (listed, of_kind), paths, (shape, of_shape) = (begun[k] for k in ("listed", "paths", "shape"))
    whole = _intersections(listed.where((F.col("kind") == "intersectionOf") & (F.col("member") != S.THING))) if of_kind["meets"] else None
    some, at_least = _existentials(shape, whole, bool(of_shape["least"]))
    some, n_some = ws.sized_tables(some=some)["some"] if of_shape["n"] else (_none(triples, some), 0)

    def of(*kinds):
        return listed.where(F.col("kind").isin(*kinds)).select("artifact_id", "node", "member")

    def counted(members):
        return members.join(members.groupBy("artifact_id", "node").agg(F.count(F.lit(1)).alias("n")), ["artifact_id", "node"])

    joins = of("unionOf", "disjointUnionOf")
    if whole is None:
        meets, alike = of("intersectionOf"), []
    else:
        spelled = of("intersectionOf").where(F.col("member") != S.THING).join(whole, ["artifact_id", "node"])
        meets = spelled.select("artifact_id", F.col("one").alias("node"), "member").distinct()
        alike = [meets, whole.select("artifact_id", "node", "one"), whole.select("artifact_id", "one", "node")]
    apart = pairs.union(of("members", "disjointUnionOf").select("artifact_id", F.col("node").alias("group_id"), "member"))

    # constructs that no artifact has are left out of the job, not joined in vain
    by_some, by_joins = [], []
    if n_some:
        senses = _senses(triples, some, paths).select("artifact_id", F.when(F.col("of_node"), F.col("node")).otherwise(F.col("target")).alias("node"), "cls")
        by_some = [some.select("artifact_id", "target", "filler"), at_least, senses]
    if of_kind["joins"]:
        by_joins = [joins.select("artifact_id", "member", "node")]
    base = subclass_edges(triples) if begun["base"] is None else begun["base"]
    told = _all([base.select(*EDGE), down, up, *alike, *by_joins, *by_some]).toDF(*EDGE)
    used = some.select("artifact_id", "p").distinct()
    roles = used.select("artifact_id", "p", F.col("p").alias("q")).union(paths.where("NOT flip").select("artifact_id", "p", "q")).distinct()
    wanted = {"told": told.where("child <> parent").distinct(), "meets": counted(meets), "joins": counted(joins), "apart": apart.distinct(), "roles": roles}
    here = {"told": 1, "apart": 1, "roles": n_some, **{k: of_kind[k] for k in ("meets", "joins")}}
    tables = ws.sized_tables(**{k: df for k, df in wanted.items() if here[k]})
    tables |= {k: (_none(triples, df), 0) for k, df in wanted.items() if not here[k]}
    tables |= {"some": (some, n_some), "transitive": begun["transitive"]}
    return NormalForms(rows={k: n for k, (_, n) in tables.items()}, **{k: t for k, (t, _) in tables.items()})


def _counted(df: DataFrame, name: str, ws: Workspace, **kinds: str):
    """(written table, its rows as n and those of each kind), counted as they are written."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in kinds.items()]]
    return ws.table(df.observe(seen, *counts), name), seen.get


def _none(triples: DataFrame, like: DataFrame) -> DataFrame:
    return triples.sparkSession.createDataFrame([], like.schema)


def _intersections(members: DataFrame) -> DataFrame:
    """(artifact_id, node, one): the node that stands for all intersections of the same members, told apart by hashes of their sets."""
    code = F.xxhash64("member")
    signature = F.concat_ws(" ", F.count(F.lit(1)), F.hex(F.bit_xor(code)), F.sum(code.cast("decimal(38,0)")).cast("string"))
    return members.groupBy("artifact_id", "node").agg(F.concat(F.lit(ALL), signature).alias("one"))


def _existentials(shape: DataFrame, whole: DataFrame | None, cardinalities: bool):
    """∃-nodes, one for every property and filler, and the edges between them and the expressions that stand for them.

    An intersection as a filler goes by the node of all that have its members.
    A restriction without a property is kept under the empty name: it needs its filler, and no more follows from it.
    ``shape`` are the triples of restrictions, ``whole`` is None where nobody has intersections, ``cardinalities`` says if they hold any.
    """
    name = F.substring_index("p", "#", -1)
    on = shape.where((name == "onProperty") & (F.col("o_kind") == "iri")).select("artifact_id", "node", F.col("value").alias("on"))
    has = shape.where(name == "hasValue").select(
        "artifact_id", "node", F.concat(F.lit(VALUE), F.concat_ws(" ", "value", "o_datatype")).alias("filler")
    )
    some = shape.where((name == "someValuesFrom") & F.col("o_kind").isin(*NODE)).select("artifact_id", "node", F.col("value").alias("filler"))
    at_least = shape.where(name.isin(*AT_LEAST) & (F.expr("try_cast(value AS INT)") >= 1)).select(
        "artifact_id", "node", (name.startswith("min") & (F.expr("try_cast(value AS INT)") == 1)).alias("same")
    )
    classes = shape.where((name == "onClass") & F.col("o_kind").isin(*NODE)).select("artifact_id", "node", F.col("value").alias("cls"))
    least = at_least.join(classes, ["artifact_id", "node"], "left").select(
        "artifact_id", "node", F.concat(F.lit(LEAST), "node").alias("made"), F.coalesce("cls", F.lit(S.THING)).alias("filler"), "same"
    )
    found = has.union(some).select("artifact_id", "node", "filler", F.col("node").alias("at"))
    if cardinalities:
        found = found.union(least.select("artifact_id", "made", "filler", F.col("node").alias("at")))
    p = F.coalesce("on", F.lit(""))
    placed = found.join(on.withColumnRenamed("node", "at"), ["artifact_id", "at"], "left").select("artifact_id", "node", p.alias("p"), "filler")
    if whole is not None:
        wholes = whole.select("artifact_id", F.col("node").alias("filler"), "one")
        placed = placed.join(wholes, ["artifact_id", "filler"], "left").select("artifact_id", "node", "p", F.coalesce("one", "filler").alias("filler"))
    # nodes of one property and filler are one class: rules see it once, however many restrictions spell it
    one = F.when(F.col("p") == "", F.col("node")).otherwise(F.concat(F.lit(SOME), F.concat_ws(" ", "p", "filler")))
    merged = placed.select("artifact_id", "node", one.alias("one"), "p", "filler")
    nodes = merged.select(
        "artifact_id", F.col("one").alias("node"), "p", "filler", F.concat(F.lit(TARGET), F.concat_ws(" ", "p", "filler")).alias("target")
    )
    both = merged.select("artifact_id", "node", "one").union(merged.select("artifact_id", "one", "node"))
    if cardinalities:
        both = both.union(least.select("artifact_id", "node", "made")).union(least.where("same").select("artifact_id", "made", "node"))
    return nodes.distinct(), both.distinct()


def _senses(triples: DataFrame, some: DataFrame, paths: DataFrame) -> DataFrame:
    """(artifact_id, node, target, cls, of_node): classes that hold of a ∃-node, or of its target, by domain and range."""
    scope = triples.where(F.col("p").isin(S.DOMAIN, S.RANGE) & F.col("o_kind").isin(*NODE)).select(
        "artifact_id", F.col("s").alias("q"), F.col("o").alias("cls"), (F.col("p") == S.DOMAIN).alias("domain")
    )
    used = some.select("artifact_id", "p").distinct()
    reached = used.select("artifact_id", "p", F.col("p").alias("q"), F.lit(False).alias("flip")).union(
        paths.select("artifact_id", "p", "q", "flip")
    )
    typed = reached.join(scope, ["artifact_id", "q"]).select("artifact_id", "p", "cls", (F.col("domain") != F.col("flip")).alias("of_node"))
    return some.join(typed.distinct(), ["artifact_id", "p"]).select("artifact_id", "node", "target", "cls", "of_node")


def under(edges: DataFrame, asked: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, node, value): the asked nodes that a node lies under, itself among them."""
    hit = asked.withColumnRenamed("value", "parent").withColumn("hit", F.lit(True))
    links = edges.join(hit, ["artifact_id", "parent"], "left").select(*EDGE, F.when(F.col("hit"), F.col("parent")).alias("value"))
    itself = asked.select("artifact_id", F.col("value").alias("child"), F.lit(None).cast("string").alias("parent"), "value")
    return ws.table(propagate(links.union(itself), ws), "under")


def saturated(forms: NormalForms, ws: Workspace, also: DataFrame | None = None):
    """(edges, facts): the told edges with all that follow, and what every node lies under of the asked nodes.

    ``also`` (artifact_id, value) adds nodes that the caller asks about.
    """
    spark = forms.told.sparkSession
    asked = forms.asked() if also is None else forms.asked().union(also).distinct()
    asked, edges, plain = ws.table(asked, "asked"), forms.told, not forms.rows["some"] + forms.rows["meets"]
    while True:
        facts = under(edges, asked, ws)
        if plain:
            return edges, facts
        known = facts.select("artifact_id", F.col("node").alias("child"), F.col("value").alias("parent"))
        met = [_met(facts, forms)] if forms.rows["meets"] else []
        new = _all([*met, *_linked(facts, forms)]).toDF(*EDGE).where("child <> parent").distinct()
        path, n = ws.write(new.join(known, EDGE, "left_anti"), "derived")
        if n == 0:
            return edges, facts
        edges = edges.union(spark.read.schema(forms.told.schema).parquet(path))


def _met(facts: DataFrame, forms: NormalForms) -> DataFrame:
    """Nodes under all members of an intersection, which thereby lie under it."""
    hits = facts.join(forms.meets.select("artifact_id", F.col("member").alias("value"), F.col("node").alias("whole"), "n"), ["artifact_id", "value"])
    return hits.groupBy("artifact_id", "node", "whole", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n").select("artifact_id", "node", "whole")


def _linked(facts: DataFrame, forms: NormalForms) -> list[DataFrame]:
    """Edges between ∃-nodes."""
    some, roles = forms.some.where("p <> ''"), forms.roles
    lower = some.select("artifact_id", F.col("node").alias("x"), "p", "target").join(roles, ["artifact_id", "p"])
    upper = some.select("artifact_id", F.col("node").alias("y"), F.col("p").alias("q"), "filler")
    of_target = facts.withColumnRenamed("node", "target")
    reached = lower.join(of_target.withColumnRenamed("value", "filler"), ["artifact_id", "target"])
    fits = reached.join(upper, ["artifact_id", "q", "filler"]).select("artifact_id", "x", "y")
    if not forms.rows["some"]:
        return []
    any_filler = lower.join(upper.where(F.col("filler") == S.THING), ["artifact_id", "q"]).select("artifact_id", "x", "y")
    if not forms.rows["transitive"]:
        return [fits, any_filler]
    # x leads to z, and z to another thing, both by a transitive t: x has a t-link there, and so a q-link where t is a q
    to_t = roles.join(forms.transitive.withColumnRenamed("p", "q"), ["artifact_id", "q"], "left_semi").withColumnRenamed("q", "t")
    from_t = roles.select("artifact_id", F.col("p").alias("t"), "q").union(forms.transitive.select("artifact_id", F.col("p").alias("t"), "p"))
    first = some.select("artifact_id", F.col("node").alias("x"), "p", "target").join(to_t, ["artifact_id", "p"])
    second = some.select("artifact_id", F.col("node").alias("z"), "p", F.col("target").alias("beyond")).join(to_t, ["artifact_id", "p"])
    chained = first.join(of_target.withColumnRenamed("value", "z"), ["artifact_id", "target"]).join(second.drop("p"), ["artifact_id", "z", "t"])
    ends = chained.select("artifact_id", "x", "t", F.col("beyond").alias("target")).join(from_t.distinct(), ["artifact_id", "t"])
    onward = ends.join(of_target.withColumnRenamed("value", "filler"), ["artifact_id", "target"]).join(upper, ["artifact_id", "q", "filler"])
    return [fits, any_filler, onward.select("artifact_id", "x", "y")]


def expression_hierarchy(triples: DataFrame, ws: Workspace, base: DataFrame | None = None):
    """(forms, edges, hierarchy): the saturated edges, and the named classes and asked nodes strictly above every node."""
    forms = normal_forms(triples, ws, base)
    edges, _ = saturated(forms, ws)
    return forms, edges, ancestors(edges, forms.asked(), ws, named=True)


def ancestors(edges: DataFrame, asked: DataFrame, ws: Workspace, named: bool = False) -> DataFrame:
    """(artifact_id, child, ancestor): the strict closure, with only the asked nodes, or those and all named ones, as ancestors.

    Blank nodes of like meaning lie under each other, so all of them as ancestors would be the square of their number.
    """
    hit = asked.withColumnRenamed("value", "parent").distinct().withColumn("hit", F.lit(True))
    shown = F.coalesce("hit", F.lit(False)) | (F.lit(named) & ~is_blank(F.col("parent")))
    links = edges.join(hit, ["artifact_id", "parent"], "left").select(*EDGE, F.when(shown, F.col("parent")).alias("value"))
    return propagate(links, ws).select("artifact_id", F.col("node").alias("child"), F.col("value").alias("ancestor"))
