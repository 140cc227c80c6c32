"""Reports, manifests, reviews and configuration from files, each with its schema and strict about what it doesn't know."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import fields
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ignore import Rule
from plumbline.plans.scan import Config
from plumbline.sources.git import SourceError

PREDICTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("sample_id", "group_id", "method", "drift_type", "gold", "prediction", "status")])
SAMPLES = T.StructType([*(T.StructField(n, T.StringType()) for n in ("sample_id", "repo_id", "repo_path", "head_sha", "document_path", "code_path", "group_id", "split", "origin", "gold", "drift_type", "rights_status", "annotation_status")), T.StructField("claim_line", T.IntegerType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON lines file; blank lines are passed over, broken ones and (strict) unknown keys fail the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    if strict:
        known = F.array(*[F.lit(n) for n in schema.fieldNames()])
        extra = F.array_except(F.json_object_keys("value"), known)
        row = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ", "))).cast(schema)).otherwise(row)
    return lines.select(row.alias("row")).select("row.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header row, with or without a byte order mark; all columns are strings."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_report_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 of every file below a folder."""
    root = folder.rstrip("/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring_index("path", root + "/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """path, problem: files of a folder that are missing, unlisted or of another SHA-256 than expected(path, sha256) says."""
    now = inventory(spark, folder).withColumnRenamed("sha256", "now")
    joined = expected.join(now, "path", "full_outer")
    problem = F.when(F.col("now").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNLISTED").when(F.col("now") != F.col("sha256"), "CHANGED")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def _build(cls: type, table: dict, where: str, convert: dict[str, Callable] | None = None):
    unknown = set(table) - {f.name for f in fields(cls)}
    if unknown:
        raise SourceError("INVALID_CONFIG", f"{where}: unknown keys {sorted(unknown)}")
    return cls(**{k: (convert or {}).get(k, lambda x: x)(v) for k, v in table.items()})


def load_config(path: str | Path | None = None, scan_date: date | None = None) -> Config:
    """A scan's configuration from TOML ([scan] top_k, method, exports; [[ignore]] rules); no path gives the defaults."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    unknown = set(raw) - {"scan", "ignore"}
    if unknown:
        raise SourceError("INVALID_CONFIG", f"unknown sections {sorted(unknown)}")
    rules = [_build(Rule, r, "ignore") for r in raw.get("ignore", [])]
    table = dict(raw.get("scan", {}))
    if "ignores" in table or "scan_date" in table:
        raise SourceError("INVALID_CONFIG", "scan: rules go under [[ignore]], the date is the run's")
    try:
        return _build(Config, table | {"ignores": rules} | ({"scan_date": scan_date} if scan_date else {}), "scan")
    except (TypeError, ValueError) as e:
        raise SourceError("INVALID_CONFIG", str(e)) from e
