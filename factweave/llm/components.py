"""Connected components by alternating large-star and small-star steps.

Each step is two shuffles of edges: a minimum for each node (summed before it is shuffled) and a
join back to it, so that a node with very many edges is split, never gathered. Rounds are written
to the shared folder, which ends their lineage. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import delete_table, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) in both directions: link each node's larger (or, small, its smaller) neighbours to the least one."""
    if large:
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        kept = edges.filter("v > u")
        least = write_table(least, "least")
        linked = kept.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.filter("v < u")
        least = write_table(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u != v").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node that has an edge (u, v); u and v of one orderable type.

    Defined results: self-loops count for nothing; repeated edges count once; null ends are dropped;
    no edges give no rows.
    """
    now = write_table(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large = write_table(_star(_both(now), True), "large")
        small = write_table(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "small")
        delete_table(now)
        delete_table(large)
        now, old = small, mark
        mark = _mark(now)
        if mark == old:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
