"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node reachable), for every node of an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until nothing changes: each step only regroups edges, so their number never
    grows, and no neighbourhood is gathered into one value. Every round is
    written to the shared folder.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = cut(small, "edges")
        before, state = state, _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    if state[0]:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
