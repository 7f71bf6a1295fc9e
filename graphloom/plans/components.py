"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b). The least neighbour is aggregated map-side and joined back, so a hub is never gathered."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = edges.withColumnRenamed("a", "u").join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (a, b) of any order -> (node, root) for each node with a link; root is the least node reachable.

    Null ends and self links are ignored; no links give no rows. Each round is written to the shared folder and takes the place of the one before.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    seen = edges.agg(state.alias("s")).first()["s"]
    for _ in range(rounds):
        if not seen[0]:
            break
        before, edges = edges, materialize(_stars(_stars(edges, large=True), large=False))
        discard(before)
        now = edges.agg(state.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
