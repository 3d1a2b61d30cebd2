"""A copy of the cells in the sites' boxes that follows a snapshot tree file by file.

Which files were copied is kept in a ledger beside the cells, one row for each site and file with the
file's length. What the listing has and the ledger lacks is copied next: a late hour of a date that
was copied before, a file that was written anew, a site that joined. Both tables are only appended
to. Cells carry their file and the batch that copied them, and count only if the ledger names that
batch as the latest of the file, so neither a batch that failed on the way nor an older form of a file
is ever read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.functions.names import below
from windspan.operators.aggregates import for_sites
from windspan.operators.joins import cells_of_sites
from windspan.operators.selection import near_any_site
from windspan.session import written
from windspan.sites import Site
from windspan.sources.snapshots import list_snapshots, scan_snapshots, snapshot_footers
from windspan.sources.tables import if_present

LEDGER = "site string, file string, length bigint, time timestamp_ntz, batch string"
FILE_KEYS = ["site", "file"]


def _ledger_path(path: str) -> str:
    return f"{path.rstrip('/')}_files"


def copied_files(spark: SparkSession, path: str) -> DataFrame:
    """(site, file, length, time, batch): the latest copy of each file for each site."""
    rows = if_present(lambda: spark.read.schema(LEDGER).parquet(_ledger_path(path)))
    if rows is None:
        return spark.createDataFrame([], LEDGER)
    latest = F.max(F.struct("batch", "length", "time")).alias("latest")
    return rows.groupBy(*FILE_KEYS).agg(latest).select(
        *FILE_KEYS, "latest.length", "latest.time", "latest.batch"
    )


def pending_files(
    files: DataFrame, copied: DataFrame, sites: Sequence[Site], root: str
) -> DataFrame:
    """Files of a listing to copy, with the site they are to be copied for, each site by its dates."""
    listed = for_sites(files.filter(F.col("status") == "ok"), sites)
    return listed.withColumn("file", below("path", root)).join(
        copied, [*FILE_KEYS, "length"], "left_anti"
    )


def refresh(
    spark: SparkSession,
    root: str,
    sites: Sequence[Site],
    path: str,
    schema: T.StructType | None = None,
) -> int:
    """Copy what is pending and say how many (site, file) pairs that was.

    With nothing pending only names are listed. Files without a footer stay pending.
    """
    todo = written(
        pending_files(list_snapshots(spark, root), copied_files(spark, path), sites, root),
        "pending",
    )
    if todo.isEmpty():
        return 0
    catalogue = written(snapshot_footers(todo.drop("site", "file").distinct()), "catalogue")
    if catalogue.filter("readable").isEmpty():
        return 0
    cells = scan_snapshots(
        spark, root, schema, where=near_any_site(sites), catalogue=catalogue, file="file"
    )
    # In order of time, so that the latest is the largest.
    batch = F.lit(f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    (
        cells_of_sites(cells, sites)
        .join(todo.select(*FILE_KEYS), FILE_KEYS, "left_semi")
        .withColumns({"date": F.date_format("time", "yyyyMMdd"), "batch": batch})
        .hint("rebalance", "site", "date")
        .write.mode("append")
        .partitionBy("site", "date", "batch")
        .parquet(path)
    )
    fine = catalogue.filter("readable").select("path")
    done = todo.join(fine, "path", "left_semi").select("site", "file", "length", "time", batch.alias("batch"))
    done = written(done, "copied")
    done.write.mode("append").parquet(_ledger_path(path))
    return done.count()


def read_copied(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the latest copy of each file, with `site` and `date` as text."""
    cells = if_present(lambda: spark.read.option("mergeSchema", "true").parquet(path))
    if cells is None:
        raise FileNotFoundError(f"no cells at {path}")
    cells = cells.withColumns({c: F.col(c).cast("string") for c in ("site", "date", "batch")})
    current = copied_files(spark, path).select(*FILE_KEYS, "batch")
    return cells.join(current, [*FILE_KEYS, "batch"], "left_semi").drop("file", "batch")


def copied_hours(spark: SparkSession, path: str) -> DataFrame:
    """(site, time): the hours each site should have, with or without cells in its box."""
    return copied_files(spark, path).select("site", "time").distinct()
