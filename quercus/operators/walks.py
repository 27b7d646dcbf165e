"""Walks over the class hierarchy, as equi-joins over shortcuts that double.

``propagate`` is the one iterative operator.  Facts travel from parent to child
until nothing new turns up.  Most nodes of a real hierarchy have no children, so
the loop runs over the *backbone* only (nodes that are somebody's parent); the
leaves are served by a single join after it has settled.  Round k moves every fact
known so far 2^k steps down at once, along shortcuts that the round before made of two
of its own, so a hierarchy of depth n takes log2(n) rounds, whatever its size.  Each round is a
written table, so lineage stays flat and the planner sees real sizes.

Nodes that are each other's parents (equivalent classes, restrictions that say the same) know the same facts.
They walk as one node and part again at the end: shortcuts from each of them to each other would
grow with the square of their number.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.functions.names import is_upper
from quercus.sources.kernel import Kernel
from quercus.workspace import Workspace

ROUND = "artifact_id string, node string, other string"
EDGE = ["artifact_id", "child", "parent"]


def subclass_edges(triples: DataFrame) -> DataFrame:
    """Named rdfs:subClassOf edges, a set per artifact."""
    return (
        triples.where(
            (F.col("p") == S.SUBCLASS) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
        )
        .select("artifact_id", F.col("s").alias("child"), F.col("o").alias("parent"))
        .distinct()
    )


def declared_classes(triples: DataFrame) -> DataFrame:
    """(artifact_id, cls): IRIs typed owl:Class or rdfs:Class."""
    return (
        triples.where(
            (F.col("p") == S.TYPE)
            & F.col("o").isin(S.CLASS, S.RDFS_CLASS)
            & (F.col("s_kind") == "iri")
        )
        .select("artifact_id", F.col("s").alias("cls"))
        .distinct()
    )


def grounding_edges(triples: DataFrame, kernel: Kernel) -> DataFrame:
    """Artifact edges plus the kernel edges each artifact can actually reach.

    Instead of copying the kernel into every artifact, only the kernel nodes an
    artifact mentions bring in the edges above them.
    """
    spark = triples.sparkSession
    edges = subclass_edges(triples)
    if not kernel.size:
        return edges
    mentioned = edges.select("artifact_id", F.explode(F.array("child", "parent")).alias("start")).union(
        declared_classes(triples)
    )
    bridge = mentioned.join(kernel.upward_table(spark), "start").select(*EDGE)
    return edges.union(bridge).distinct()


def propagate(links: DataFrame, ws: Workspace) -> DataFrame:
    """Least fixpoint of facts flowing down a hierarchy.

    ``links(artifact_id, child, parent, value)``: a non-null ``value`` is a fact
    about ``child``; a non-null ``parent`` lets every fact of the parent reach the
    child.  Returns distinct ``(artifact_id, node, value)``.  Cycles are fine.
    """
    backbone, leaves, alike = _walked(links, ws)
    return (backbone if alike is None else _apart(backbone, alike)).union(leaves)


def _walked(links: DataFrame, ws: Workspace):
    """(facts of the backbone, facts of the leaves, (artifact_id, node, rep) or None): a group of equals has its facts at its rep only."""
    spark = links.sparkSession
    parents = (
        links.where("parent IS NOT NULL")
        .select("artifact_id", F.col("parent").alias("child"))
        .distinct()
        .withColumn("inner", F.lit(True))
    )
    flagged = links.join(parents, ["artifact_id", "child"], "left").select(
        *EDGE, "value", F.coalesce("inner", F.lit(False)).alias("inner")
    )
    path, _ = ws.write(flagged, "links", partition_by="inner")
    stored = spark.read.schema(links.select(*EDGE, "value").schema.add("inner", "boolean")).parquet(path)
    inner, alike = _condensed(stored.where("inner"), ws)
    settled = _settle(inner, ws)
    leaves = stored.where("NOT inner")
    above = leaves.where("parent IS NOT NULL").select("artifact_id", "child", F.col("parent").alias("node"))
    if alike is not None:
        above = _as_one(above, "node", alike)
    own = leaves.where("value IS NOT NULL").select(
        "artifact_id", F.col("child").alias("node"), "value"
    )
    inherited = above.join(settled, ["artifact_id", "node"]).select(
        "artifact_id", F.col("child").alias("node"), "value"
    )
    return settled, own.union(inherited).distinct(), alike


def _condensed(inner: DataFrame, ws: Workspace):
    """(links between groups of nodes that are each other's parents, (artifact_id, node, rep) of these groups or None).

    A group goes by its smallest node, which has no row of its own.
    """
    up = inner.where("child <> parent").select(*EDGE).distinct()
    back = up.select("artifact_id", F.col("parent").alias("child"), F.col("child").alias("parent"))
    mutual = up.where("child > parent").join(back, EDGE, "left_semi")
    path, n = ws.write(mutual.toDF("artifact_id", "node", "rep"), "alike")
    if n == 0:
        return inner, None
    alike = _smallest(inner.sparkSession.read.schema("artifact_id string, node string, rep string").parquet(path), ws)
    links = _as_one(_as_one(inner, "child", alike), "parent", alike).select(
        "artifact_id", "child", F.when(F.col("child") != F.col("parent"), F.col("parent")).alias("parent"), "value"
    )
    return ws.table(links.where("parent IS NOT NULL OR value IS NOT NULL").distinct(), "condensed"), alike


def _as_one(df: DataFrame, column: str, alike: DataFrame) -> DataFrame:
    """``df`` with the nodes of a column named after their groups."""
    named = df.join(alike.withColumnRenamed("node", column), ["artifact_id", column], "left")
    return named.withColumn(column, F.coalesce("rep", column)).select(df.columns)


def _apart(facts: DataFrame, alike: DataFrame) -> DataFrame:
    """The facts of groups as facts of each of their nodes."""
    itself = alike.select("artifact_id", F.col("rep").alias("node"), "rep").distinct()
    members = alike.union(itself).select("artifact_id", F.col("node").alias("member"), F.col("rep").alias("node"))
    return facts.join(members, ["artifact_id", "node"], "left").select(
        "artifact_id", F.coalesce("member", "node").alias("node"), "value"
    )


def _smallest(pairs: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, node, rep): the smallest node of every other node's connected component.

    ``pairs`` (artifact_id, node, rep) with node > rep, a written table.  Rounds of a large star and a small star, each of joins with grouped minima,
    until all rows are stars: nobody has two smallest nodes, and no smallest node has one itself.
    """
    while True:
        ends = pairs.select("artifact_id", "node", F.lit(1).alias("row")).union(pairs.select("artifact_id", "rep", F.lit(0)).distinct())
        if ends.groupBy("artifact_id", "node").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row")).where("n > 1 AND row = 1").isEmpty():
            return pairs
        both = pairs.toDF("artifact_id", "node", "other").union(pairs.select("artifact_id", "rep", "node"))
        least = both.groupBy("artifact_id", "node").agg(F.least(F.min("other"), "node").alias("rep"))
        large = both.where("other > node").join(least, ["artifact_id", "node"]).select("artifact_id", F.col("other").alias("node"), "rep").distinct()
        low = large.groupBy("artifact_id", "node").agg(F.min("rep").alias("low"))
        small = large.join(low, ["artifact_id", "node"])
        linked = small.select("artifact_id", "node", F.col("low").alias("rep")).union(
            small.where("rep <> low").select("artifact_id", "rep", "low")
        )
        pairs = ws.table(linked.distinct(), "alike")


def _settle(inner: DataFrame, ws: Workspace):
    """Run the loop over the backbone.

    After round k all facts within 2^(k+1) - 1 steps are known. A fact that is farther away has one on its way
    that round k would have found, so a round without news is the last one; so is one that no shortcut outlasts.
    On a circle shortcuts never end, on a tree every node has one at most; their number is bounded by the backbone's own closure.
    A round writes its news and the next shortcuts in one job.
    """
    spark = inner.sparkSession
    told = inner.where("value IS NOT NULL").select("artifact_id", F.col("child").alias("node"), "value").distinct()
    jump = inner.where("parent IS NOT NULL").select("artifact_id", F.col("parent").alias("node"), F.col("child").alias("below")).distinct()
    rounds, seen = [], told
    while True:
        moved = seen.join(jump, ["artifact_id", "node"]).select("artifact_id", F.col("below").alias("node"), "value").distinct()
        news = moved.join(seen, ["artifact_id", "node", "value"], "left_anti").select("artifact_id", "node", F.col("value").alias("other"), F.lit(True).alias("fact"))
        second = jump.select("artifact_id", F.col("node").alias("below"), F.col("below").alias("beyond"))
        twice = jump.join(second, ["artifact_id", "below"]).select("artifact_id", "node", F.col("beyond").alias("other")).distinct()
        found = Observation()
        both = news.union(twice.withColumn("fact", F.lit(False)))
        path, n = ws.write(both.observe(found, F.count_if("fact").alias("facts")), "round", partition_by="fact")
        facts = found.get["facts"] if n else 0
        if facts:
            rounds.append(path)
            seen = told.union(_part(spark, rounds, True).toDF("artifact_id", "node", "value"))
        if facts == 0 or facts == n:
            return seen
        jump = _part(spark, [path], False).toDF("artifact_id", "node", "below")


def _part(spark, paths, fact: bool) -> DataFrame:
    """Facts or shortcuts of written rounds."""
    return spark.read.schema(ROUND).parquet(*[f"{p}/fact={str(fact).lower()}" for p in paths])


def entry_points(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(artifact_id, cls, upper_iri): the first upper category on every path up.

    The walk stops there: the upper ontology's own closure covers the rest, which
    also keeps its hub categories out of every shuffle.
    """
    up = is_upper(F.col("parent"))
    links = edges.select(
        "artifact_id",
        "child",
        F.when(~up, F.col("parent")).alias("parent"),
        F.when(up, F.col("parent")).alias("value"),
    )
    return propagate(links, ws).select(
        "artifact_id", F.col("node").alias("cls"), F.col("value").alias("upper_iri")
    )


def closure(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Strict transitive closure (artifact_id, child, ancestor); cycle-safe."""
    return propagate(edges.withColumn("value", F.col("parent")), ws).select(
        "artifact_id", F.col("node").alias("child"), F.col("value").alias("ancestor")
    )


@dataclass
class Ancestors:
    """A strict closure that is not spelled out: its rows are the facts of every node's rep, its number of rows is arithmetic.

    Of n equal classes there are n facts and n members, where the closure has n² rows.
    """

    facts: DataFrame  # artifact_id, node, ancestor: of a node that is a rep or stands alone
    members: DataFrame | None  # artifact_id, child, node: the nodes of groups, each group's rep among them; None: all stand alone

    def rows(self, children: DataFrame | None = None) -> DataFrame:
        """(artifact_id, child, ancestor), child <> ancestor: spelled out, for all nodes or those of ``children`` (artifact_id, child)."""
        return self._of_children(self.facts, children).where("child <> ancestor").select("artifact_id", "child", "ancestor")

    def counts(self) -> DataFrame:
        """(artifact_id, child, n): how many rows each child has."""
        n = self.facts.groupBy("artifact_id", "node").agg(F.count(F.lit(1)).alias("n"))
        loops = self.facts.where("node = ancestor").select("artifact_id", F.col("ancestor").alias("child"))
        if self.members is not None:
            own = self.members.select("artifact_id", "node", F.col("child").alias("ancestor"))
            loops = loops.union(self.facts.join(own, ["artifact_id", "node", "ancestor"], "left_semi").select("artifact_id", "ancestor")).distinct()
        each = self._of_children(n).join(loops.withColumn("own", F.lit(1)), ["artifact_id", "child"], "left")
        return each.select("artifact_id", "child", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))

    def _of_children(self, by_node: DataFrame, children: DataFrame | None = None) -> DataFrame:
        """Rows of nodes as rows of every child, or of some children."""
        if self.members is None:
            rows = by_node.withColumnRenamed("node", "child")
            return rows if children is None else rows.join(children, ["artifact_id", "child"], "left_semi")
        if children is None:
            rows = by_node.join(self.members, ["artifact_id", "node"], "left")
        else:
            placed = children.select("artifact_id", "child").join(self.members, ["artifact_id", "child"], "left")
            rows = by_node.join(placed.withColumn("node", F.coalesce("node", "child")), ["artifact_id", "node"])
        return rows.withColumn("child", F.coalesce("child", "node"))


def ancestors_once(edges: DataFrame, ws: Workspace) -> Ancestors:
    """``closure`` with equals kept as one."""
    backbone, leaves, alike = _walked(edges.select(*EDGE).withColumn("value", F.col("parent")), ws)
    facts = ws.table(backbone.union(leaves).toDF("artifact_id", "node", "ancestor"), "ancestors")
    if alike is None:
        return Ancestors(facts, None)
    itself = alike.select("artifact_id", F.col("rep").alias("node"), "rep").distinct()
    return Ancestors(facts, alike.union(itself).toDF("artifact_id", "child", "node"))


def reaches(edges: DataFrame, targets, ws: Workspace) -> DataFrame:
    """(artifact_id, cls, target): classes that are, or fall under, one of a few target classes."""
    wanted = list(targets)
    links = edges.withColumn("value", F.when(F.col("parent").isin(wanted), F.col("parent")))
    itself = edges.select("artifact_id", F.explode(F.array("child", "parent")).alias("child")).where(F.col("child").isin(wanted)).distinct()
    links = links.union(itself.select("artifact_id", "child", F.lit(None).cast("string"), "child"))
    return propagate(links, ws).select(
        "artifact_id", F.col("node").alias("cls"), F.col("value").alias("target")
    )
