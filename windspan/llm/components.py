"""Connected components of an edge table, by alternating stars.

Each round points every node to the smallest of its neighbours, first for the larger neighbours
of a node and then for the smaller ones, until each component is a star round its smallest node.
A node with very many neighbours is only ever aggregated (which combines before the shuffle) and
joined, so no task has to hold its neighbours. Each round is a written table: a lost executor
costs re-reading files, and no plan grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windspan.session import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is linked to the smallest of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        near.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def component_labels(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's smallest node.

    Null ends and loops are no edges; an empty edge table gives no rows. Raises if `rounds` are
    not enough (each about halves the distance to the root, so 60 are for any input).
    """
    now = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), "edges"
    )

    def state(df: DataFrame):
        return df.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        ).first()

    before = state(now)
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "edges")
        after = state(now)
        if after == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(
                roots.select(F.col("root").alias("node"), "root").distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
