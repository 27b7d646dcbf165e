"""Asserted disjointness, kept as groups so that long lists stay linear."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus import schema as S
from quercus.workspace import Workspace


def list_members(triples: DataFrame, heads: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Members of RDF lists: ``heads(artifact_id, owner, head)`` -> (artifact_id, owner, member, member_kind, position).

    By pointer doubling: round k knows every cell within 2^k steps of its head and
    where 2^k steps lead from any cell, so a list of n cells takes log2(n) rounds. Lists that
    share a tail or run in a circle end like any other, when a round brings nothing new. A cell's position is
    its smallest distance from the head, from 0.
    """
    ws = ws or Workspace(triples.sparkSession)
    spark = triples.sparkSession
    kept = "artifact_id string, owner string, node string, position bigint"
    key = ["artifact_id", "owner", "node"]
    jump = triples.where((F.col("p") == S.REST) & (F.col("o") != S.NIL)).select(
        "artifact_id", F.col("s").alias("node"), F.col("o").alias("next")
    ).distinct()
    heads = heads.select("artifact_id", "owner", F.col("head").alias("node")).distinct().withColumn("position", F.lit(0).cast("bigint"))
    step = ws.beside(rest=lambda: ws.write(jump, "rest"), cells=lambda: ws.write(heads, "cells"))
    paths, span, links = [step["cells"][0]], 1, "artifact_id string, node string, next string"
    # the cells that a round reaches and the jumps of the next one do not rest on each other
    while step["cells"][1] and step["rest"][1]:
        cells, jump = spark.read.schema(kept).parquet(*paths), spark.read.schema(links).parquet(step["rest"][0])
        ahead = cells.join(jump, ["artifact_id", "node"]).groupBy("artifact_id", "owner", F.col("next").alias("node")).agg(
            (F.min("position") + span).alias("position")
        )
        second = jump.select("artifact_id", F.col("node").alias("next"), F.col("next").alias("beyond"))
        reached = ahead.join(cells, key, "left_anti").select(*key, "position")
        twice = jump.join(second, ["artifact_id", "next"]).select("artifact_id", "node", F.col("beyond").alias("next")).distinct()
        step = ws.beside(rest=partial(ws.write, twice, "rest"), cells=partial(ws.write, reached, "cells"))
        if step["cells"][1]:
            paths.append(step["cells"][0])
        span *= 2
    first = triples.where(F.col("p") == S.FIRST).select(
        "artifact_id", F.col("s").alias("node"), F.col("o").alias("member"), "o_kind"
    )
    return spark.read.schema(kept).parquet(*paths).join(first, ["artifact_id", "node"]).select(
        "artifact_id", "owner", "member", F.col("o_kind").alias("member_kind"), "position"
    )


def property_chains(triples: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(artifact_id, chain, q, position, p, n): the links of every propertyChainAxiom of q, in order from 0; n links in all.

    Chains with a member that is no IRI are left out.
    """
    told = triples.where((F.col("p") == S.owl("propertyChainAxiom")) & (F.col("s_kind") == "iri"))
    heads = told.select("artifact_id", F.concat_ws(" ", "s", "o").alias("owner"), F.col("o").alias("head"))
    links = list_members(triples, heads, ws)
    length = links.groupBy("artifact_id", "owner").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("places"), F.bool_and(F.col("member_kind") == "iri").alias("named")
    )
    return links.join(length.where("named AND n = places"), ["artifact_id", "owner"]).select(
        "artifact_id", F.col("owner").alias("chain"), F.substring_index("owner", " ", 1).alias("q"), "position", F.col("member").alias("p"), "n"
    )


def disjoint_groups(triples: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(artifact_id, group_id, member): classes of one group are pairwise disjoint."""
    pair = triples.where(
        (F.col("p") == S.DISJOINT) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
    ).select(
        "artifact_id",
        F.concat_ws(" ", F.least("s", "o"), F.greatest("s", "o")).alias("group_id"),
        F.explode(F.array("s", "o")).alias("member"),
    )
    lists = triples.where((F.col("p") == S.TYPE) & (F.col("o") == S.owl("AllDisjointClasses"))).select(
        "artifact_id", F.col("s").alias("owner")
    )
    heads = triples.where(F.col("p") == S.owl("members")).select(
        "artifact_id", F.col("s").alias("owner"), F.col("o").alias("head")
    )
    members = list_members(triples, heads.join(lists, ["artifact_id", "owner"], "left_semi"), ws)
    return pair.union(
        members.where("member_kind = 'iri'").select(
            "artifact_id", F.col("owner").alias("group_id"), "member"
        )
    ).distinct()


#: Groups of more members are exported as chains, a line or two per member, instead of pair by pair.
PAIRED = 16


def sized(groups: DataFrame) -> DataFrame:
    """``groups`` with the number of members of each, ``size``."""
    sizes = groups.groupBy("artifact_id", "group_id").agg(F.count(F.lit(1)).alias("size"))
    return groups.join(sizes, ["artifact_id", "group_id"])


def asserted_pairs(groups: DataFrame) -> DataFrame:
    """Every disjoint pair a < b of every group given.

    Their number is the square of a group's size: it is for groups whose size is bounded, or for who asks for pairs. Clash
    tests never need pairs, they count the group's members a class falls under, and exports write chains for long groups.
    """
    left = groups.select("artifact_id", "group_id", F.col("member").alias("a"))
    right = groups.select("artifact_id", "group_id", F.col("member").alias("b"))
    return left.join(right, ["artifact_id", "group_id"]).where("a < b").select("artifact_id", "a", "b").distinct()


def within_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of the pairs (artifact_id, a, b) whose sides are members of one group."""
    left = pairs.join(groups.select("artifact_id", "group_id", F.col("member").alias("a")), ["artifact_id", "a"])
    return left.join(groups.select("artifact_id", "group_id", F.col("member").alias("b")), ["artifact_id", "group_id", "b"]).select(
        "artifact_id", "a", "b"
    ).distinct()


def pair_counts(groups: DataFrame) -> DataFrame:
    """(artifact_id, n): how many different pairs the groups make disjoint, by arithmetic on sizes.

    Members with the same groups of three or more count together: within such a class every two are a pair, and two
    classes that share a group make as many pairs as the product of their sizes. Pairs that are asserted singly are
    added where no longer group holds them. Classes of members are told apart by hashes of their sets of groups.
    """
    all_ = sized(groups)
    singles = all_.where("size = 2").groupBy("artifact_id", "group_id").agg(F.min("member").alias("a"), F.max("member").alias("b"))
    singles = singles.select("artifact_id", "a", "b").distinct()
    longer = all_.where("size > 2").select("artifact_id", "group_id", "member")
    beyond = singles.join(within_groups(singles, longer), ["artifact_id", "a", "b"], "left_anti")
    code = F.xxhash64("group_id")
    kept = longer.groupBy("artifact_id", "member").agg(
        F.struct(F.count(F.lit(1)), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).alias("signature")
    )
    classes = longer.join(kept, ["artifact_id", "member"]).groupBy("artifact_id", "group_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    inside = classes.select("artifact_id", "signature", "n").distinct().select("artifact_id", F.expr("n * (n - 1) div 2").alias("pairs"))
    other = classes.select("artifact_id", "group_id", F.col("signature").alias("second"), F.col("n").alias("m"))
    across = (
        classes.join(other, ["artifact_id", "group_id"]).where("signature < second")
        .select("artifact_id", "signature", "second", F.expr("n * m").alias("pairs")).distinct().select("artifact_id", "pairs")
    )
    ones = beyond.select("artifact_id", F.lit(1).cast("bigint").alias("pairs"))
    return inside.union(across).union(ones).groupBy("artifact_id").agg(F.sum("pairs").alias("n"))
