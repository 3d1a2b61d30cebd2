"""Trees of hourly grid snapshots: listing, footers, scan, filtered copy.

A *catalogue* is a stored table of one listing and one look at each footer. Schema, readability, hours,
rejects and the schema profile all follow from it, so no file's footer is opened twice for them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.functions.clock import date_between
from windspan.functions.names import (
    below,
    file_stem,
    folder_date_text,
    stem_date_text,
    stem_time,
)
from windspan.operators.joins import cells_of_sites
from windspan.session import setting, written
from windspan.sites import Site

# Functions sent to executors carry their helpers, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PATHS = 5
_FIELD = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("name", "type", "stored")]
)


def _with_names(df: DataFrame, path: str, root: str) -> DataFrame:
    return df.withColumns(
        {"folder_date": folder_date_text(path, root), "stem": file_stem(path)}
    ).withColumn("time", stem_time("stem"))


def _in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is None and end is None:
        return df
    return df.filter(date_between("folder_date", start or "0001-01-01", end or "9999-12-31"))


def list_snapshots(
    spark: SparkSession, root: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One row per Parquet file below a date folder: path, length, folder_date, stem, time and
    `status`: ok, bad_name (no time in the name) or wrong_folder (name and folder disagree).

    Only names are listed; no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(unglobbed(root))
        .select("path", "length")
    )
    return _in_range(named_files(files, root), start, end)


def named_files(files: DataFrame, root: str) -> DataFrame:
    """What the names of files (`path`) below a date folder say."""
    return (
        _with_names(files, "path", root)
        .filter(F.col("folder_date") != "")
        .withColumn(
            "status",
            F.when(F.col("time").isNull(), "bad_name")
            .when(stem_date_text("stem") != F.col("folder_date"), "wrong_folder")
            .otherwise("ok"),
        )
    )


def folder_dates(spark: SparkSession, root: str) -> DataFrame:
    """The date folders below `root`, in order."""
    return (
        list_snapshots(spark, root)
        .select(F.col("folder_date").alias("date"))
        .distinct()
        .orderBy("date")
    )


def read_catalogue(
    spark: SparkSession, root: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """The listing with what each footer says, stored. Files without a time in their names are
    not opened; `readable` is NULL for them."""
    files = list_snapshots(spark, root, start, end)
    return written(snapshot_footers(files, closed=("bad_name",)), "catalogue")


def rejects(catalogue: DataFrame) -> DataFrame:
    """Files of a catalogue that a scan leaves out, and why."""
    unreadable = (F.col("status") == "ok") & ~F.col("readable")
    return catalogue.filter((F.col("status") != "ok") | ~F.col("readable")).select(
        "path", F.when(unreadable, "unreadable").otherwise(F.col("status")).alias("status")
    )


def rejected_snapshots(spark: SparkSession, root: str, footers: bool = False) -> DataFrame:
    """Files left out and why; with `footers`, unreadable ones too, which opens every file."""
    if footers:
        return rejects(read_catalogue(spark, root))
    return list_snapshots(spark, root).filter(F.col("status") != "ok").select("path", "status")


def _opened(path: str):
    """An open file on an executor; one that cannot be opened raises."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        filesystem, inner = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        # Object stores go by one scheme in Hadoop and another in Arrow.
        scheme = "s3" if scheme in ("s3a", "s3n") else scheme
        filesystem, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@=')}")
    handle = filesystem.open_input_file(inner)
    handle.read_at(1, 0)
    return handle


def _unless_damaged(read, handle):
    """What `read` makes of an open Parquet file; None if the file is not in order."""
    import pyarrow as pa

    try:
        return read(handle)
    except OSError as broken:
        if broken.errno:  # the system's, not the format's
            raise
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass
    return None


def _spark_type(kind) -> str | None:
    """An Arrow type as Spark reads it; None for types it cannot read without further settings."""
    import pyarrow as pa
    from pyspark.errors import PySparkException
    from pyspark.sql.pandas.types import from_arrow_type

    if pa.types.is_dictionary(kind):
        kind = kind.value_type
    if pa.types.is_timestamp(kind) and kind.unit == "ns":
        return None
    unsigned = {"uint8": "smallint", "uint16": "int", "uint32": "bigint"}
    if str(kind) in unsigned:
        return unsigned[str(kind)]
    try:
        return from_arrow_type(kind, True).simpleString()
    except PySparkException:
        return None


def _spread(files: DataFrame) -> DataFrame:
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path")


def snapshot_footers(files: DataFrame, closed: Sequence[str] = ()) -> DataFrame:
    """Read the footer of every listed file, on the executors: its columns, with their types in
    Spark and as stored, and its row count.

    A file whose footer is no Parquet is unreadable. One that cannot be opened fails the job: it
    may hold cells. Files whose status is in `closed` are not opened.
    """

    def footer(handle):
        import pyarrow.parquet as pq

        return pq.ParquetFile(handle).metadata

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signatures, counts, fields, fine = [], [], [], []
            left = batch["status"].isin(closed) if closed else [False] * len(batch)
            for path, shut in zip(batch["path"], left):
                meta = None
                if not shut:
                    with _opened(path) as handle:
                        meta = _unless_damaged(footer, handle)
                schema = [] if meta is None else meta.schema.to_arrow_schema()
                signatures.append(
                    None if meta is None else ", ".join(f"{f.name}: {f.type}" for f in schema)
                )
                counts.append(None if meta is None else meta.num_rows)
                fields.append(
                    [
                        {"name": f.name, "type": _spark_type(f.type), "stored": str(f.type)}
                        for f in schema
                    ]
                )
                fine.append(None if shut else meta is not None)
            yield batch.assign(
                signature=signatures,
                num_rows=pd.array(counts, dtype="Int64"),
                readable=pd.array(fine, dtype="boolean"),
                fields=fields,
            )

    schema = T.StructType(
        [
            *files.schema.fields,
            T.StructField("signature", T.StringType()),
            T.StructField("num_rows", T.LongType()),
            T.StructField("readable", T.BooleanType()),
            T.StructField("fields", T.ArrayType(_FIELD)),
        ]
    )
    return _spread(files).mapInPandas(read, schema)


def whole_files(files: DataFrame) -> DataFrame:
    """Add `whole` to a catalogue: whether all rows of a file can be read. Opens every file that has
    a footer and reads it through, a row group at a time."""

    def rows(handle):
        import pyarrow.parquet as pq

        file = pq.ParquetFile(handle)
        return sum(file.read_row_group(i).num_rows for i in range(file.num_row_groups))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = []
            for path, readable in zip(batch["path"], batch["readable"]):
                if pd.isna(readable) or not readable:
                    whole.append(False)
                    continue
                with _opened(path) as handle:
                    whole.append(_unless_damaged(rows, handle) is not None)
            yield batch.assign(whole=whole)

    names = files.select("path", "readable")
    schema = T.StructType([*names.schema.fields, T.StructField("whole", T.BooleanType())])
    checked = _spread(names).mapInPandas(read, schema).drop("readable")
    return files.join(checked, "path")


def united_schema(catalogue: DataFrame) -> T.StructType:
    """The columns of all readable files, in the order of the first file that has each.

    Columns that Spark cannot read, such as nanosecond times, are left out. One name with two
    types fails.
    """
    columns = (
        catalogue.filter("readable")
        .groupBy("signature")
        .agg(F.min("path").alias("path"), F.first("fields").alias("fields"))
        .select("path", F.posexplode("fields").alias("at", "field"))
        .groupBy("field.name")
        .agg(
            F.min(F.struct("path", "at")).alias("first"),
            F.array_sort(F.collect_set("field.type")).alias("types"),
        )
        .orderBy("first")
        .collect()  # one row for each column name
    )
    clash = [f"{c.name}: {', '.join(c.types)}" for c in columns if len(c.types) > 1]
    if clash:
        raise ValueError(f"files disagree on the types of {'; '.join(clash)}")
    ddl = ", ".join(f"`{c.name.replace('`', '``')}` {c.types[0]}" for c in columns if c.types)
    return T.StructType.fromDDL(ddl) if ddl else T.StructType()


def schema_profile(footers: DataFrame) -> DataFrame:
    """Files per schema signature, with the paths themselves where a group has few.

    Give it a stored table of footers, as it is read twice. The rank test is applied before
    the shuffle too, so a signature shared by almost every file sends a handful of paths.
    """
    readable = footers.filter("readable").select("signature", "path")
    counts = readable.groupBy("signature").agg(F.count(F.lit(1)).alias("n_files"))
    order = Window.partitionBy("signature").orderBy("path")
    few = (
        readable.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= SAMPLE_PATHS)
        .groupBy("signature")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
    )
    return counts.join(few, "signature").withColumn(
        "paths", F.when(F.col("n_files") <= SAMPLE_PATHS, F.col("paths"))
    )


def scan_snapshots(
    spark: SparkSession,
    root: str,
    schema: T.StructType | None = None,
    start: str | None = None,
    end: str | None = None,
    same_date: bool = True,
    skip_unreadable: bool = True,
    where: Column | None = None,
    catalogue: DataFrame | None = None,
    file: str | None = None,
) -> DataFrame:
    """All grid cells below `root` with their event `time`, as one scan.

    Dates, names, the name/folder guard and readability are settled on the catalogue, made here
    where none is given; the scan opens the files that are left and no others. Their paths go
    through the driver, as do those of any scan's files. Without a schema, the columns of these
    files are united. A file that turns out damaged behind its footer fails the job, as half of
    its cells would give a wrong maximum; so does one without a footer unless `skip_unreadable`.

    Give the test on cells that drops most rows (`near_any_site`) as `where`: it comes before the
    time is taken from the path. `file` names a column to hold the path below `root`.
    """
    if catalogue is None:
        catalogue = read_catalogue(spark, root, start, end)
    wanted = _in_range(catalogue, start, end).filter(
        F.col("status").isin("ok", *([] if same_date else ["wrong_folder"]))
    )
    if skip_unreadable:
        wanted = wanted.filter("readable")
    if schema is None:
        schema = united_schema(wanted)
    paths = [unglobbed(r.path) for r in wanted.select("path").orderBy("path").toLocalIterator()]
    if not paths:
        cells = spark.createDataFrame([], schema).withColumn("_path", F.lit(""))
    else:
        reader = spark.read.option("ignoreCorruptFiles", "false").schema(schema)
        reader = reader.option("recursiveFileLookup", "true").option("mergeSchema", "false")
        # Spark looks each path up once more, else with a task for each.
        tasks = str(spark.sparkContext.defaultParallelism)
        with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks):
            cells = reader.parquet(*paths)
        if where is not None:
            cells = cells.filter(where)
        cells = cells.select("*", F.col("_metadata.file_path").alias("_path"))
    named = cells.withColumn("time", stem_time(file_stem("_path")))
    if file is not None:
        named = named.withColumn(file, below(uri_decoded("_path"), root))
    return named.drop("_path")


def unglobbed(path: str) -> str:
    """A path whose characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def uri_decoded(path: str) -> Column:
    """A file's path as listings spell it; scans give it as an URI."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def expected_hours(files: DataFrame) -> DataFrame:
    """The hours with at least one readable, well-named file, of a listing or a catalogue."""
    files = files.filter(F.col("status") == "ok")
    if "readable" not in files.columns:
        files = snapshot_footers(files)
    return files.filter("readable").select("time").distinct()


def write_snapshots(cells: DataFrame, root: str, time="time", mode="error") -> None:
    """Lay cells out as date folders and hour folders, the form the scan reads."""
    stem = F.concat(F.date_format(time, "yyyy-MM-dd_HH_mm_ss"), F.lit(".parquet"))
    (
        cells.withColumns({"day": F.date_format(time, "yyyyMMdd"), "hour_file": stem})
        .drop(time)
        .hint("rebalance", "day", "hour_file")
        .write.mode(mode)
        .partitionBy("day", "hour_file")
        .parquet(root)
    )


def write_mirror(
    cells: DataFrame, sites: Sequence[Site], path: str, only: DataFrame | None = None
) -> None:
    """Write each site's cells by (site, date), replacing only the dates present.

    `only` limits the copy to its (site, date) pairs.
    """
    found = cells_of_sites(cells, sites).withColumn("date", F.date_format("time", "yyyyMMdd"))
    if only is not None:
        found = found.join(only, ["site", "date"], "left_semi")
    (
        found.hint("rebalance", "site", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site", "date")
        .parquet(path)
    )


def read_mirror(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """`site` and `date` come back as text, whatever their folders look like."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).withColumns(
        {"site": F.col("site").cast("string"), "date": F.col("date").cast("string")}
    )


def done_dates(spark: SparkSession, path: str) -> DataFrame:
    """Dates already written for each site, from the folder names; no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    return files.select(
        F.regexp_extract("path", "/site=([^/]+)/date=", 1).alias("site"),
        F.regexp_extract("path", "/date=([0-9]{8})/", 1).alias("date"),
    ).distinct()
