"""Helpers that the training-data operators share: Arrow row mappers, written intermediate tables, word hashing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even when only the driver has it on its path."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = REPO + (os.pathsep + have if have else "")


#: Where a session names no shared folder: one of its own for each application. Tables that spool wrote and nothing deleted yet.
_own: dict[str, str] = {}
_spooled: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; an own temporary one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def uri_of(spark: SparkSession, folder: str) -> str:
    """A folder as a full URI, resolved as Spark itself resolves it, so that Python workers open the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", uri).replace("s3a://", "s3://", 1)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors.

    The files last until release() or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _spooled:
        atexit.register(_release_all)
    _spooled[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _release_all() -> None:
    for name, spark in _spooled.items():
        try:
            _delete(spark, name)
        except Exception:  # noqa: BLE001 - the session has ended: its folder is the cluster's to clear
            return
    _spooled.clear()


def release(*frames: DataFrame) -> None:
    """Delete the files behind spooled tables that nothing reads any more."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)
            for known in [k for k in _spooled if name.endswith(k.removeprefix("file://"))]:
                del _spooled[known]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], dict[str, Iterable]]], fields: list[T.StructField], piece_chars: int = 4_000_000) -> DataFrame:
    """One output row per input row: its id and the columns that make()(texts) gives for groups of at most about piece_chars characters.

    Null ids, repeated rows and null texts (empty) keep their rows; any other columns are left behind.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        arrow = None
        for batch in batches:
            arrow = arrow or arrow_schema(schema, batch.schema.field(0).type)
            for a, b in groups(batch.column(1), piece_chars):
                out = work(texts_of(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(out[n], arrow.field(n).type) for n in names)], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]], piece_chars: int = 4_000_000) -> DataFrame:
    """The rows of df, all columns as they are, for whose text make()(texts) is true; nothing is shuffled.

    A text column of another type is read as its cast to string.
    """
    ship(df.sparkSession)
    width = len(df.columns)
    typed = isinstance(df.schema[text_col].dataType, T.StringType)
    place = df.columns.index(text_col) if typed else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a, b in groups(batch.column(place), piece_chars):
                part = batch.slice(a, b - a)
                yield part.select(range(width)).filter(pa.array(work(texts_of(part.column(place))), pa.bool_()))

    return (df if typed else df.select("*", F.col(text_col).cast("string").alias("text as string"))).mapInArrow(run, df.schema)


def groups(column: pa.Array, piece_chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about piece_chars bytes together; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > piece_chars:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def arrow_schema(schema: T.StructType, id_type: pa.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([pa.field(f.name, id_type if i == 0 else to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)])


class Memo(dict):
    """A map of bounded size: it is emptied when full, so results never depend on what it holds."""

    def __init__(self, cap: int):
        super().__init__()
        self.cap = cap

    def fill(self, keys: list, values: Iterable) -> None:
        if len(self) + len(keys) > self.cap:
            self.clear()
        self.update(zip(keys, values))


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, parts: int = 1000) -> DataFrame:
    """left joined to right, which has each key once and in weight the rows that left has of it, at least.

    Keys with over 1/parts of all rows, of which there can't be more than parts, are broadcast; so no task gets a hot key.
    Null keys match nothing and are dropped; both inputs should be cheap to read again.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * parts > total).drop(weight)
    rest = right.where(F.col(weight) * parts <= total).drop(weight)
    if hot.isEmpty():
        return left.join(rest, key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of the links and the smallest node that it reaches, by alternating large and small stars.

    Each round is written to the shared folder, so lost executors cost one round at most; the number of rounds grows with
    the logarithm of the number of nodes. Groups are reduced before they are shuffled, and the links of a hub are joined where they
    are, to a broadcast of at most 1,000 hubs. No links give an empty table.
    """
    edges = spool(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        mark = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = spool(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "neighbours")
        large = join_unique(both.where("v > u"), near, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spool(large, "large-star")
        least = spool(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_unique(large, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, spool(small, "small-star")
        release(old, near, large, least)
