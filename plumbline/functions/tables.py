"""Written intermediate tables, for plans that loop."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Python workers import the package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Where a session names no shared folder: one of its own for each application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own temporary one in local tests that name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        _own[app] = tempfile.mkdtemp(prefix="plumbline-tables-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def in_order(df: DataFrame, keys: list[str], order: str, cost: str, name: str, start: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """keys, order, and name: what a fresh start() says to the costs of each key's rows, one after another in order.

    The rows are sorted within their partition and go by in batches, so a task holds one batch, however many rows a key has.
    """
    rows = df.select(*keys, order, F.col(cost).cast("long").alias("cost")).repartition(*keys).sortWithinPartitions(*keys, order)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in (*keys, order)), T.StructField(name, T.BooleanType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, take = None, None
        for batch in batches:
            out = []
            for *key, cost_of in zip(*(batch.column(i).to_pylist() for i in (*range(n), n + 1))):
                if take is None or key != last:
                    last, take = key, start()
                out.append(take(cost_of))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), pa.array(out, pa.bool_())], names=schema.names)

    ship(df.sparkSession)
    return rows.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names (an own one in local tests): short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Seconds of named stages, added up: with stages("scan"): …"""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start
