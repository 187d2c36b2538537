"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize


def components(edges: DataFrame, n_edges: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternates the large-star and the small-star step, each an aggregate with partial sums and an equi-join (a hub's rows
    are split by adaptive skew joins), until the edges are stars around their smallest node. Each round is written to the
    shared folder. `n_edges` may bound the number of edges. No edges: no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", n_edges)
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", 2 * state["n"])
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
