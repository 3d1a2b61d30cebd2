"""Take in new snapshot files as they arrive, once each.

The checkpoint remembers which files were read, so nothing keeps a list of finished dates. A
batch writes below its own number; repeating a batch after a failure replaces what it wrote,
and a date whose hours arrive in several batches keeps them all. One hour's maximum is a
maximum of maxima, so no state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from windspan.functions.names import file_stem, folder_date_text, stem_date_text, stem_time
from windspan.operators.joins import cells_of_sites
from windspan.operators.selection import near_any_site
from windspan.session import written
from windspan.sites import Site
from windspan.sources.snapshots import named_files, scan_snapshots, snapshot_footers, whole_files


def snapshot_stream(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    files_per_batch: int = 10_000,
    where: Column | None = None,
    skip_damaged: bool = False,
) -> DataFrame:
    """Cells of new files; `where` is tested first, before the tests on the file path.

    A damaged file fails the batch, which can be repeated once the file is mended or gone.
    `skip_damaged` takes in what can be read of such files instead, and nothing of it later."""
    cells = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("ignoreCorruptFiles", str(skip_damaged).lower())
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(root)
    )
    if where is not None:
        cells = cells.filter(where)
    path = F.col("_metadata.file_path")
    stem = file_stem(path)
    return cells.filter(stem_date_text(stem) == folder_date_text(path, root)).select(
        "*", stem_time(stem).alias("time")
    ).filter(F.col("time").isNotNull())


def ingest(
    cells: DataFrame, sites: Sequence[Site], mirror: str, checkpoint: str
) -> StreamingQuery:
    """Start a run over everything not yet seen; it ends when that is written."""

    return (
        cells_of_sites(cells, sites)
        .writeStream.foreachBatch(lambda batch, number: _write_batch(batch, mirror, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_tree(
    spark: SparkSession,
    root: str,
    sites: Sequence[Site],
    mirror: str,
    checkpoint: str,
    quarantine: str,
    schema: T.StructType | None = None,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Take in a snapshot tree's new files, and set those aside that cannot be read whole.

    The stream is one of file names. Each batch looks at its files' footers, reads those that have
    one, and lists the others in `quarantine` (path, length, status, batch). Where a file proves
    damaged behind its footer, the batch's files are read through one by one, the damaged ones go
    to quarantine too and the others are taken in, so no file is half read and none stops the rest.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path", "length")
    )

    def take_in(batch: DataFrame, number: int) -> None:
        # The batch's own session: settings of the stream hold there.
        files = written(
            snapshot_footers(named_files(batch, root), closed=("bad_name",)), "batch-files"
        )
        try:
            _take_cells(files, root, sites, mirror, number, schema)
        except Exception:
            files = written(whole_files(files), "batch-files")
            if files.filter("status = 'ok' and readable and not whole").isEmpty():
                raise
            files = files.withColumn("readable", F.col("readable") & F.col("whole"))
            _take_cells(files, root, sites, mirror, number, schema)
        status = F.when(F.col("status") == "ok", "unreadable").otherwise(F.col("status"))
        (
            files.filter("status <> 'ok' or not readable")
            .select("path", "length", status.alias("status"), F.lit(number).alias("batch"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(quarantine)
        )

    return (
        names.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _take_cells(
    files: DataFrame,
    root: str,
    sites: Sequence[Site],
    mirror: str,
    number: int,
    schema: T.StructType | None,
) -> None:
    cells = scan_snapshots(
        files.sparkSession, root, schema, where=near_any_site(sites), catalogue=files
    )
    if cells.schema.fieldNames() != ["time"]:
        _write_batch(cells_of_sites(cells, sites), mirror, number)


def _write_batch(cells: DataFrame, mirror: str, number: int) -> None:
    (
        cells.withColumns({"date": F.date_format("time", "yyyyMMdd"), "batch": F.lit(number)})
        .hint("rebalance", "site", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site", "date", "batch")
        .parquet(mirror)
    )


def ingested(spark: SparkSession, mirror: str) -> DataFrame:
    """What has been taken in so far, as cells."""
    return spark.read.option("mergeSchema", "true").parquet(mirror).drop("batch").withColumns(
        {"site": F.col("site").cast("string"), "date": F.col("date").cast("string")}
    )
