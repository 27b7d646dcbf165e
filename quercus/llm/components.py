"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is joins and grouped minima (pre-aggregated, so a hub is no hot group) and is
written to the shared folder; edges end as stars around the smallest node.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.workspace import Workspace


#: Parts that the edges of a node are dealt to.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest of u and its neighbours.

    A component's root is a hub, so a node's edges are reduced and joined part by part: no key holds
    more than a part of them.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("low"))
    least = parts.groupBy("u").agg(F.least(F.min("low"), F.first("u")).alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def _stars(edges: DataFrame, ws: Workspace) -> DataFrame:
    """One large-star and one small-star step over (u, v) rows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: every u has only smaller neighbours v here
    small = _with_least(large)
    return ws.table(
        small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        .select("e.*").where("u <> v").distinct(),
        "stars",
    )


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(u, v): v is the smallest node of u's component; smallest nodes themselves have no row."""
    edges = ws.table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while (now := _state(edges)) != before:
        before, edges = now, _stars(edges, ws)
    return edges
