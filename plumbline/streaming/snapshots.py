"""Snapshots that arrive as a stream of files tables: each batch is scanned by the same plan as a batch job.

The plan itself needs whole repositories, so a repository's files must arrive in one file of the stream, as one snapshot.
A snapshot that was seen before, by repository and commit, is dropped within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.schemas import FILES
from plumbline.plans.scan import Config, Report, scan

SNAPSHOTS = T.StructType([*FILES.fields, T.StructField("arrived", T.TimestampType())])


def read_snapshots(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """files of the Parquet tables that arrive in folder, repeated files of a commit once."""
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 100).parquet(folder)
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["repo_id", "head_sha", "path"])


def scan_stream(stream: DataFrame, checkpoint: str, sink: Callable[[Report, int], None], config: Config = Config()) -> StreamingQuery:
    """Starts a query that scans what is there and hands each batch's report to sink; sinks should write by batch id, so that a batch that
    is run again replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(scan(batch.drop("arrived"), config), batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_per_window(findings: DataFrame, at: str = "arrived", width: str = "1 day") -> DataFrame:
    """Conflicts of each drift type in each window of time."""
    return findings.groupBy(F.window(at, width).alias("window"), "drift_type").agg(F.count(F.lit(1)).alias("findings")).select(F.col("window.start").alias("start"), "drift_type", "findings")
