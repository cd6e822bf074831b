"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS
from tidemark.workspace import materialise


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """One round. Minima are pre-aggregated before the shuffle; they are broadcast if ``small``, else the join back can be split on skew."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(F.broadcast(least) if small else least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    to_least = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for each end of ``edges`` (columns u, v; any order, repeats and loops allowed).

    component is the smallest node of the group. Ids are longs; edges with a null end are ignored; no edges give no rows.
    Every round's edges are written to the shared folder, so a lost executor costs at most one round.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, most = None, edges.count()
    while True:
        # A star has at most one minimum for each end of an edge, and a round makes no more than three edges of one.
        small = 6 * most <= BROADCAST_ROWS
        edges = materialise(_star(_star(edges, True, small), False, small), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state, most = now, now[0]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
