"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 1 << 30


def lowest(keys: DataFrame, group: str, hash: str, most: int) -> DataFrame:
    """Of distinct (group, hash) rows the `most` with the smallest hashes in each group.

    Groups are labels, few enough for the driver. Their sizes give a share of hash values that
    holds about twice the rows wanted, so that however large a group is, no task sorts more.
    """
    sizes = {r[group]: r["n"] for r in keys.groupBy(group).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return keys
    limits: list[Column] = []
    for name, n in sizes.items():
        limits += [F.lit(name), F.lit(min(PARTS, -(-PARTS * 2 * most // n)))]
    few = keys.filter(F.pmod(hash, F.lit(PARTS)) < F.create_map(*limits)[F.col(group)])
    order = Window.partitionBy(group).orderBy(F.pmod(hash, F.lit(PARTS)), hash)
    return few.withColumn("__pick", F.row_number().over(order)).filter(
        F.col("__pick") <= most
    ).drop("__pick")
