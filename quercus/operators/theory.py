"""First-order theory of each artifact, as tables, as text lines, and as a Horn check."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import is_upper, local_name, logic_symbol
from quercus.operators.disjointness import PAIRED, asserted_pairs, disjoint_groups, pair_counts, sized, within_groups
from quercus.operators.lint import straddle_pairs
from quercus.operators.ranking import first_per_group, grouped_rank
from quercus.operators.walks import entry_points, propagate, subclass_edges
from quercus.sources.upper import CONTINUANT, OCCURRENT, Upper
from quercus.workspace import Workspace


@dataclass
class Theory:
    classes: DataFrame  # artifact_id, iri, label, sym, kind
    subsumptions: DataFrame  # artifact_id, sub, sup
    disjoints: DataFrame  # artifact_id, a, b, origin: pairs of groups of at most PAIRED members, and of the upper ontology
    chains: DataFrame  # artifact_id, group_id, symbol, iri, place, occurrents, size: longer groups, occurrents first
    groups: DataFrame  # artifact_id, group_id, member: asserted groups of any length
    properties: DataFrame  # artifact_id, iri, label, sym


def class_kinds(entries: DataFrame, classes: DataFrame, upper: Upper) -> DataFrame:
    """(artifact_id, iri, kind): continuant, occurrent, or unknown when neither or both."""
    spark = classes.sparkSession
    reached = entries.select("artifact_id", F.col("cls").alias("iri"), "upper_iri").where(~is_upper(F.col("iri")))
    itself = classes.where(is_upper(F.col("iri"))).select("artifact_id", "iri", F.col("iri").alias("upper_iri"))
    roots = upper.ancestor_table(spark).where(F.col("ancestor").isin(CONTINUANT, OCCURRENT)).select(
        F.col("iri").alias("upper_iri"), "ancestor"
    )
    sides = (
        reached.union(itself)
        .join(roots, "upper_iri")
        .groupBy("artifact_id", "iri")
        .agg(
            F.bool_or(F.col("ancestor") == CONTINUANT).alias("c"),
            F.bool_or(F.col("ancestor") == OCCURRENT).alias("o"),
        )
    )
    return classes.join(sides, ["artifact_id", "iri"], "left").select(
        "artifact_id", "iri",
        F.when(F.col("c") & ~F.col("o"), "continuant").when(F.col("o") & ~F.col("c"), "occurrent")
        .otherwise("unknown").alias("kind"),
    )


def symbols(named: DataFrame, ws: Workspace) -> DataFrame:
    """Unique symbols: ``named(artifact_id, iri, label, is_property)`` plus ``sym``.

    The nth holder of a base symbol, classes first and by IRI, gets ``_n``.  Where a suffixed
    symbol meets another one, the owner of the plain base keeps it and the others are
    suffixed again, until no two in an artifact are alike.
    """
    based = named.withColumn("base", logic_symbol(F.col("label")))
    ranked = grouped_rank(based, ["artifact_id", "base"], ["is_property", "iri"], ws)
    keep = ["artifact_id", "iri", "label", "is_property", "given", "sym"]
    suffixed = F.concat_ws("_", "base", F.col("rank").cast("string"))
    now = ws.table(
        ranked.withColumn("given", F.col("rank") > 1)
        .withColumn("sym", F.when(F.col("given"), suffixed).otherwise(F.col("base"))).select(*keep),
        "symbols",
    )
    while not now.groupBy("artifact_id", "sym").count().where("count > 1").isEmpty():
        ranked = grouped_rank(now, ["artifact_id", "sym"], ["given", "is_property", "iri"], ws)
        again = F.col("rank") > 1
        now = ws.table(
            ranked.withColumn("given", F.col("given") | again)
            .withColumn("sym", F.when(again, F.concat_ws("_", "sym", F.col("rank").cast("string"))).otherwise(F.col("sym")))
            .select(*keep),
            "symbols",
        )
    return now.drop("given")


def build_theory(triples: DataFrame, upper: Upper, ws: Workspace) -> Theory:
    spark = triples.sparkSession
    edges = ws.table(subclass_edges(triples), "edges")
    groups = ws.table(disjoint_groups(triples, ws), "groups")
    typed = triples.where((F.col("p") == S.TYPE) & (F.col("s_kind") == "iri"))
    declared = typed.where(F.col("o") == S.CLASS).select("artifact_id", F.col("s").alias("iri"))
    ends = edges.select("artifact_id", F.explode(F.array("child", "parent")).alias("iri"))
    main = declared.union(ends).where(~local_name(F.col("iri")).isin("Thing", "Nothing", "Class"))
    iris = main.union(groups.select("artifact_id", F.col("member").alias("iri"))).distinct()
    labels = upper.label_table(spark).withColumnRenamed("label", "upper_label")

    def labelled(df, is_property):
        return df.join(labels, "iri", "left").select(
            "artifact_id", "iri", F.coalesce("upper_label", local_name(F.col("iri"))).alias("label"),
            F.lit(is_property).alias("is_property"),
        )

    props = typed.where(F.col("o") == S.OBJECT_PROPERTY).select("artifact_id", F.col("s").alias("iri")).distinct()
    named = ws.table(symbols(labelled(iris, False).union(labelled(props, True)), ws), "symbols")
    kinds = class_kinds(entry_points(edges, ws), iris, upper)
    classes = ws.table(
        named.where("NOT is_property").drop("is_property").join(kinds, ["artifact_id", "iri"]), "classes"
    )
    known = classes.select("artifact_id", F.col("iri"))
    subs = (
        edges.join(known.withColumnRenamed("iri", "child"), ["artifact_id", "child"], "left_semi")
        .join(known.withColumnRenamed("iri", "parent"), ["artifact_id", "parent"], "left_semi")
        .select("artifact_id", F.col("child").alias("sub"), F.col("parent").alias("sup"))
    )
    by_size = sized(groups)
    asserted = asserted_pairs(by_size.where(F.col("size") <= PAIRED))
    referenced = referenced_categories(edges)
    # One pseudo-class per artifact: its set of categories is at most the upper ontology.
    clashing = straddle_pairs(referenced.withColumn("cls", F.lit("")), upper).select("artifact_id", "a", "b")
    beyond = clashing.join(within_groups(clashing, groups), ["artifact_id", "a", "b"], "left_anti")
    return Theory(
        classes=classes,
        subsumptions=subs,
        disjoints=asserted.withColumn("origin", F.lit("asserted")).union(beyond.withColumn("origin", F.lit("bfo"))),
        chains=chains(by_size.where(F.col("size") > PAIRED), classes, ws),
        groups=groups,
        properties=named.where("is_property").drop("is_property"),
    )


def chains(long: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame:
    """Members of long groups in a row, occurrents first, with the group's symbol and its number of occurrents."""
    if long.isEmpty():
        return long.select(
            "artifact_id", "group_id", F.lit("").alias("symbol"), F.col("member").alias("iri"), F.lit(0).cast("bigint").alias("place"),
            F.lit(0).cast("bigint").alias("occurrents"), "size",
        )
    known = classes.select("artifact_id", F.col("iri").alias("member"), (F.col("kind") != "occurrent").alias("lasting"))
    kinds = long.join(known, ["artifact_id", "member"])
    names = grouped_rank(long.select("artifact_id", "group_id").distinct(), ["artifact_id"], ["group_id"], ws, "number")
    occurrents = kinds.groupBy("artifact_id", "group_id").agg(F.count_if(~F.col("lasting")).alias("occurrents"))
    placed = grouped_rank(kinds, ["artifact_id", "group_id"], ["lasting", "member"], ws, "place").drop("_n")
    named = names.select("artifact_id", "group_id", F.concat(F.lit("g"), F.col("number").cast("string")).alias("symbol"))
    found = placed.join(occurrents, ["artifact_id", "group_id"]).join(named, ["artifact_id", "group_id"])
    columns = ["artifact_id", "group_id", "symbol", F.col("member").alias("iri"), "place", "occurrents", "size"]
    return ws.table(found.select(*columns), "chains")


def disjoint_pairs(theory: Theory) -> DataFrame:
    """(artifact_id, a, b, origin): every pair, those of long groups spelled out too."""
    pairs = asserted_pairs(theory.groups).withColumn("origin", F.lit("asserted"))
    return pairs.union(theory.disjoints.where("origin = 'bfo'"))


def referenced_categories(edges: DataFrame) -> DataFrame:
    """(artifact_id, upper_iri): upper categories that are somebody's direct parent."""
    return edges.where(is_upper(F.col("parent"))).select("artifact_id", F.col("parent").alias("upper_iri")).distinct()


def stats(theory: Theory) -> DataFrame:
    kinds = theory.classes.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("classes"),
        *[
            F.count_if(F.col("kind") == k).alias(n)
            for k, n in (("continuant", "continuants"), ("occurrent", "occurrents"), ("unknown", "unknown_kind"))
        ],
    )
    out = kinds
    extra = theory.disjoints.where("origin = 'bfo'").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pair_counts(theory.groups).union(extra).groupBy("artifact_id").agg(F.sum("n").alias("disjoint_axioms"))
    for df, name in ((theory.subsumptions, "subsumptions"), (theory.properties, "properties")):
        out = out.join(df.groupBy("artifact_id").agg(F.count(F.lit(1)).alias(name)), "artifact_id", "left")
    out = out.join(pairs, "artifact_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        *kinds.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("subsumptions", "disjoint_axioms", "properties")],
    )


# -- rendering -------------------------------------------------------------------

# Line templates (%1$s, %2$s symbols) of the two exchange syntaxes.
TEMPLATES = {
    "prover9": {
        ("sub", 2): "  all X (instance_of_at(X,%1$s) -> instance_of_at(X,%2$s)).",
        ("sub", 3): "  all X all T (instance_of(X,%1$s,T) -> instance_of(X,%2$s,T)).",
        ("dis", 2): "  all X (-(instance_of_at(X,%1$s) & instance_of_at(X,%2$s))).",
        ("dis", 3): "  all X all T (-(instance_of(X,%1$s,T) & instance_of(X,%2$s,T))).",
    },
    "clif": {
        ("sub", 2): "  (forall (x) (if (instance_of_at x %1$s) (instance_of_at x %2$s)))",
        ("sub", 3): "  (forall (x t) (if (instance_of x %1$s t) (instance_of x %2$s t)))",
        ("dis", 2): "  (forall (x) (not (and (instance_of_at x %1$s) (instance_of_at x %2$s))))",
        ("dis", 3): "  (forall (x t) (not (and (instance_of x %1$s t) (instance_of x %2$s t))))",
    },
}
# Lines of a chain. %1$s is a class, %2$s what the members before it come to, %3$s what they come to with it;
# "first" begins a chain, "with" joins it, and "apart" also keeps off what came before.
CHAIN = {
    "prover9": {
        ("first", 2): "  all X (instance_of_at(X,%1$s) -> one_of_at(X,%3$s)).",
        ("apart", 2): "  all X ((instance_of_at(X,%1$s) -> (one_of_at(X,%3$s) & -one_of_at(X,%2$s))) & (one_of_at(X,%2$s) -> one_of_at(X,%3$s))).",
        ("first", 3): "  all X all T (instance_of(X,%1$s,T) -> one_of(X,%3$s,T)).",
        ("with", 3): "  all X all T ((instance_of(X,%1$s,T) | one_of(X,%2$s,T)) -> one_of(X,%3$s,T)).",
        ("apart", 3): "  all X all T ((instance_of(X,%1$s,T) -> (one_of(X,%3$s,T) & -one_of(X,%2$s,T))) & (one_of(X,%2$s,T) -> one_of(X,%3$s,T))).",
    },
    "clif": {
        ("first", 2): "  (forall (x) (if (instance_of_at x %1$s) (one_of_at x %3$s)))",
        ("apart", 2): "  (forall (x) (and (if (instance_of_at x %1$s) (and (one_of_at x %3$s) (not (one_of_at x %2$s)))) (if (one_of_at x %2$s) (one_of_at x %3$s))))",
        ("first", 3): "  (forall (x t) (if (instance_of x %1$s t) (one_of x %3$s t)))",
        ("with", 3): "  (forall (x t) (if (or (instance_of x %1$s t) (one_of x %2$s t)) (one_of x %3$s t)))",
        ("apart", 3): "  (forall (x t) (and (if (instance_of x %1$s t) (and (one_of x %3$s t) (not (one_of x %2$s t)))) (if (one_of x %2$s t) (one_of x %3$s t))))",
    },
}
FRAME = {
    "prover9": {
        "head": ["% The artifact's classes as a first-order theory; input for a prover or a model finder.", None, "set(prolog_style_variables).", "", "formulas(assumptions)."],
        "note": "% Membership has a time, instance_of(x, C, t), but for occurrents: instance_of_at(x, C).",
        "aligned": "% Membership has a time throughout: instance_of(x, C, t).",
        "sub": "  % what falls under what",
        "dis": "  % what excludes what",
        "tail": "end_of_list.",
    },
    "clif": {
        "head": [";; The artifact's classes as a first-order theory in Common Logic.", None, "(cl-text ontology-export"],
        "note": ";; Membership has a time, (instance_of x C t), but for occurrents: (instance_of_at x C).",
        "aligned": ";; Membership has a time throughout: (instance_of x C t).",
        "sub": "  ;; what falls under what",
        "dis": "  ;; what excludes what",
        "tail": ")",
    },
}
MISMATCH = "  % the two differ in kind"


def _with_class(df: DataFrame, classes: DataFrame, key: str, tag: str) -> DataFrame:
    side = classes.select(
        "artifact_id", F.col("iri").alias(key), F.col("sym").alias(f"sym_{tag}"),
        F.col("kind").alias(f"kind_{tag}"), F.col("label").alias(f"label_{tag}"),
    )
    return df.join(side, ["artifact_id", key])


def _arity(align: bool) -> Column:
    both = (F.col("kind_l") == "occurrent") & (F.col("kind_r") == "occurrent")
    return F.lit(3) if align else F.when(both, 2).otherwise(3)


def _line(syntax: str, family: str, align: bool) -> Column:
    two, three = (F.format_string(TEMPLATES[syntax][family, n], "sym_l", "sym_r") for n in (2, 3))
    return F.when(_arity(align) == 2, two).otherwise(three)


def _chain_lines(theory: Theory, syntax: str, align: bool) -> DataFrame:
    """Long groups, a line per member and predicate: every member keeps off what all members before it come to.

    Two occurrents exclude each other in the binary predicate and any other two members in the ternary one, as
    pairs do; so occurrents have a binary chain, and a ternary one that they join before the others keep off it.
    """
    rows = _with_class(theory.chains, theory.classes, "iri", "l")
    occurrent = F.lit(False) if align else F.col("place") <= F.col("occurrents")
    name = lambda at: F.concat_ws("_", "symbol", (F.col("place") - at).cast("string"))

    def line(kind, arity):
        return F.format_string(CHAIN[syntax][kind, arity], F.col("sym_l"), name(1), name(0))

    binary = F.when(F.col("place") == 1, line("first", 2)).otherwise(line("apart", 2))
    ternary = F.when(F.col("place") == 1, line("first", 3)).when(occurrent, line("with", 3)).otherwise(line("apart", 3))
    mark = F.lit("  % asserted" if syntax == "prover9" else "  ;; asserted")
    cells = F.array(
        F.struct(F.lit("2").alias("arity"), F.when(occurrent & (F.col("occurrents") > 1), binary).alias("text")),
        F.struct(F.lit("3").alias("arity"), F.when(~occurrent | (F.col("occurrents") < F.col("size")), ternary).alias("text")),
    )
    return rows.select("artifact_id", "group_id", "place", F.inline(cells)).where("text IS NOT NULL").select(
        "artifact_id", F.lit(4).alias("section"),
        F.concat_ws(" ", F.lit("~"), "group_id", "arity", F.lpad(F.col("place").cast("string"), 12, "0")).alias("sort_key"),
        F.concat("text", mark).alias("line"),
    )


def render(theory: Theory, syntax: str = "prover9", align_bfo: bool = False) -> DataFrame:
    """The theory as text lines (artifact_id, section, sort_key, line).

    Order by (section, sort_key) to get a file; lines stay rows so that no artifact
    has to fit into one task.  Sections: 0 head, 1/2 subsumptions, 3/4 disjointness, 5 tail.
    """
    frame = FRAME[syntax]
    subs = _with_class(_with_class(theory.subsumptions, theory.classes, "sub", "l"), theory.classes, "sup", "r")
    text = _line(syntax, "sub", align_bfo)
    if syntax == "prover9" and not align_bfo:
        mixed = (
            (F.col("kind_l") != F.col("kind_r"))
            & (F.col("kind_l") != "unknown") & (F.col("kind_r") != "unknown")
        )
        text = F.concat(text, F.when(mixed, MISMATCH).otherwise(""))
    sub_lines = subs.select("artifact_id", F.lit(2).alias("section"), F.concat_ws(" ", "sub", "sup").alias("sort_key"), text.alias("line"))
    dis = _with_class(_with_class(theory.disjoints, theory.classes, "a", "l"), theory.classes, "b", "r")
    tag = F.when(F.col("origin") == "bfo", "BFO").otherwise("asserted")
    if syntax == "prover9":
        note = F.concat(F.lit("  % "), tag, F.lit(": "), F.col("label_l"), F.lit(" / "), F.col("label_r"))
    else:
        note = F.concat(F.lit("  ;; "), tag)
    dis_lines = dis.select(
        "artifact_id", F.lit(4).alias("section"), F.concat_ws(" ", "a", "b").alias("sort_key"),
        F.concat(_line(syntax, "dis", align_bfo), note).alias("line"),
    )
    dis_lines = dis_lines.union(_chain_lines(theory, syntax, align_bfo))
    fixed = [frame["aligned" if align_bfo else "note"] if t is None else t for t in frame["head"]]
    shell = [(0, f"{i:02d}", t) for i, t in enumerate(fixed)] + [(5, "", frame["tail"])]
    artifacts = theory.classes.select("artifact_id").distinct()

    def constant(df, rows):
        cells = [
            F.struct(F.lit(n).alias("section"), F.lit(k).alias("sort_key"), F.lit(t).alias("line")) for n, k, t in rows
        ]
        return df.select("artifact_id", F.inline(F.array(*cells)))

    return (
        constant(artifacts, shell)
        .union(constant(theory.subsumptions.select("artifact_id").distinct(), [(1, "", frame["sub"])]))
        .union(sub_lines)
        .union(constant(dis_lines.select("artifact_id").distinct(), [(3, "", frame["dis"])]))
        .union(dis_lines)
    )


# -- Horn check ----------------------------------------------------------------------


def empty_classes(theory: Theory, upper: Upper, ws: Workspace) -> DataFrame:
    """(artifact_id, iri, label, verdict) for every class outside the upper ontology.

    The exported theory is Horn: a class is empty when, within one predicate
    (binary for occurrents, ternary otherwise), it implies both sides of a
    disjointness.  Nodes of the walk are therefore (predicate, class).
    """
    classes, none = theory.classes, F.lit(None).cast("string")
    kinds = classes.select("artifact_id", "iri", (F.col("kind") == "occurrent").alias("occ"))
    subs = _with_class(_with_class(theory.subsumptions, classes, "sub", "l"), classes, "sup", "r")
    arity = _arity(False).cast("string")
    edges = subs.select(
        "artifact_id", F.concat_ws(" ", arity, "sub").alias("child"), F.concat_ws(" ", arity, "sup").alias("parent")
    )
    pairs = theory.disjoints.where("origin = 'bfo'")
    targets = ws.table(
        theory.groups.select("artifact_id", F.col("member").alias("iri"))
        .union(pairs.select("artifact_id", F.explode(F.array("a", "b")).alias("iri")))
        .distinct()
        .select("artifact_id", F.explode(F.array(F.concat(F.lit("2 "), "iri"), F.concat(F.lit("3 "), "iri"))).alias("parent")),
        "targets",
    )
    hit = targets.withColumn("value", F.col("parent"))
    links = edges.join(hit, ["artifact_id", "parent"], "left").select("artifact_id", "child", "parent", "value").union(
        targets.select("artifact_id", F.col("parent").alias("child"), none.alias("parent"), F.col("parent").alias("value"))
    )
    implied = propagate(links, ws).select(
        "artifact_id", F.substring_index("node", " ", -1).alias("cls"),
        F.substring_index("node", " ", 1).alias("arity"), F.substring_index("value", " ", -1).alias("iri"),
    )
    goal = kinds.where(~is_upper(F.col("iri"))).select(
        "artifact_id", F.col("iri").alias("cls"), F.when(F.col("occ"), "2").otherwise("3").alias("arity")
    )
    # Only what a class implies in its own predicate counts.
    implied = ws.table(
        implied.join(goal, ["artifact_id", "cls", "arity"], "left_semi").join(kinds, ["artifact_id", "iri"]), "implied"
    )
    fits = ((F.col("arity") == "2") & (F.col("n_occ") > 1)) | (
        (F.col("arity") == "3") & (F.col("n") > 1) & (F.col("n_occ") < F.col("n"))
    )
    by_group = (
        implied.join(theory.groups.withColumnRenamed("member", "iri"), ["artifact_id", "iri"])
        .groupBy("artifact_id", "cls", "arity", "group_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("occ").alias("n_occ"))
        .where(fits)
        .select("artifact_id", "cls")
    )
    by_upper = straddle_pairs(
        implied.where(is_upper(F.col("iri"))).select("artifact_id", "cls", F.col("iri").alias("upper_iri")), upper
    ).join(pairs.select("artifact_id", "a", "b"), ["artifact_id", "a", "b"], "left_semi")
    sides = by_upper.join(kinds.toDF("artifact_id", "a", "occ_a"), ["artifact_id", "a"]).join(
        kinds.toDF("artifact_id", "b", "occ_b"), ["artifact_id", "b"]
    ).join(goal, ["artifact_id", "cls"])
    by_upper = sides.where((F.col("arity") == "2") == (F.col("occ_a") & F.col("occ_b"))).select("artifact_id", "cls")
    empty = by_group.union(by_upper).distinct().select("artifact_id", F.col("cls").alias("iri"), F.lit(True).alias("empty"))
    return (
        classes.where(~is_upper(F.col("iri")))
        .join(empty, ["artifact_id", "iri"], "left")
        .select(
            "artifact_id", "iri", "label",
            F.when(F.col("empty"), "unsatisfiable").otherwise("satisfiable").alias("verdict"),
        )
    )


def tested_classes(verdicts: DataFrame, limit: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """Every class, or the first ``limit`` per artifact by lower-cased label, ties by IRI."""
    if limit is None:
        return verdicts
    keyed = verdicts.withColumn("key", F.lower("label"))
    return first_per_group(keyed, ["artifact_id"], ["key", "iri"], limit, ws or Workspace(verdicts.sparkSession)).drop("key")


def divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(artifact_id, name, side): names only one of two systems reports, or both."""
    return (
        left.select("artifact_id", "name").distinct().withColumn("l", F.lit(True))
        .join(right.select("artifact_id", "name").distinct().withColumn("r", F.lit(True)), ["artifact_id", "name"], "full")
        .select(
            "artifact_id", "name",
            F.when(F.col("l").isNull(), "only_reasoner").when(F.col("r").isNull(), "only_prover")
            .otherwise("both").alias("side"),
        )
    )


def cross_check(verdicts: DataFrame, reasoner: DataFrame, limit: int | None = None) -> DataFrame:
    """Agreement per artifact over all classes; with ``limit``, NULL where more exist than were tested."""
    capped = F.lit(False) if limit is None else F.col("candidates") > limit
    totals = verdicts.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("candidates"))
    tested = tested_classes(verdicts, limit)
    prover = tested.where("verdict = 'unsatisfiable'").select("artifact_id", F.col("label").alias("name"))
    sides = divergence(prover, reasoner).groupBy("artifact_id").agg(
        F.count_if(F.col("side") != "only_reasoner").alias("prover_unsatisfiable"),
        F.count_if(F.col("side") != "only_prover").alias("reasoner_unsatisfiable"),
        F.count_if(F.col("side") == "only_prover").alias("only_prover"),
        F.count_if(F.col("side") == "only_reasoner").alias("only_reasoner"),
    )
    zero = F.lit(0).cast("bigint")
    out = totals.join(sides, "artifact_id", "left").select(
        "artifact_id",
        F.when(capped, F.lit(limit)).otherwise(F.col("candidates")).cast("bigint").alias("tested"),
        capped.alias("capped"),
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("prover_unsatisfiable", "reasoner_unsatisfiable", "only_prover", "only_reasoner")
        ],
    )
    same = (F.col("only_prover") == 0) & (F.col("only_reasoner") == 0)
    return out.withColumn("agree", F.when(~F.col("capped"), same))


def exports(theory: Theory, align_bfo: bool = False) -> dict:
    """Both renderings and the statistics."""
    return {s: render(theory, s, align_bfo) for s in TEMPLATES} | {"stats": stats(theory)}
