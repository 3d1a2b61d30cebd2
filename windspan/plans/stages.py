"""Which stages of a run are finished, and from what they were made.

A log beside the stage tables, only appended to: a row when a stage is begun and one when its table is
whole. A stage counts as finished if its last row says so and names the inputs it would be made from
now. So a table whose writing was cut off is made again, and so is one whose inputs have changed.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windspan.functions.names import below
from windspan.sources.tables import if_present

LOG = "at bigint, stage string, inputs string, run string, finished boolean"


def listing_mark(files: DataFrame, root: str) -> str:
    """A digest of the names below `root` and lengths of a listing, whatever its order."""
    row = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(
            F.sum(F.xxhash64(below("path", root), "length").cast("decimal(38,0)")), F.lit(0)
        ).alias("sum"),
        F.coalesce(F.bit_xor(F.xxhash64("length", below("path", root))), F.lit(0)).alias("xor"),
    ).first()
    return f"{row['n']}:{row['sum']}:{row['xor']}"


def mark(*parts: object) -> str:
    """A digest of values by their spelling."""
    return hashlib.sha256("\n".join(map(repr, parts)).encode()).hexdigest()


class StageLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, stage: str, inputs: str, run: str, finished: bool) -> None:
        row = (time.time_ns(), stage, inputs, run, finished)
        self.spark.createDataFrame([row], LOG).write.mode("append").parquet(self.path)

    def begin(self, stage: str, inputs: str) -> str:
        """From now on the stage's table is not to be taken; gives a name for the run."""
        run = uuid.uuid4().hex
        self._append(stage, inputs, run, False)
        return run

    def finish(self, stage: str, inputs: str, run: str) -> None:
        self._append(stage, inputs, run, True)

    def finished(self, stage: str, inputs: str) -> bool:
        rows = if_present(lambda: self.spark.read.schema(LOG).parquet(self.path))
        if rows is None:
            return False
        last = rows.filter(F.col("stage") == stage).agg(F.max(F.struct("at", "finished", "inputs")).alias("r")).first().r
        return last is not None and last.finished and last.inputs == inputs
