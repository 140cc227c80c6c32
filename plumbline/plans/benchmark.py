"""Benchmarks: a manifest of samples to predictions and metrics, with one scan for all states that the samples name."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import metrics, scopes
from plumbline.plans.scan import Config, scan
from plumbline.sources.files import SAMPLES, read_jsonl
from plumbline.sources.git import SourceError, read_repository, resolve_ref


def state_of(path: str, sha: str) -> str:
    return f"{path}@{sha}"


def predict(samples: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """sample_id, group_id, method, drift_type, gold, prediction, status: what one scan of files says of every sample's place.

    samples has repo_id, document_path, claim_line, code_path and drift_type; a claim counts if it covers the line. A conflict counts only as
    a finding that was published.
    """
    report = scan(files, config)
    at = report.judgments.select("repo_id", "claim_id", "decision", F.col("span.path").alias("document_path"), F.col("span.start_line").alias("a"), F.col("span.end_line").alias("b"), F.col("fact.fact_kind").alias("kind"), F.col("fact.span.path").alias("code"))
    shown = report.findings.select("repo_id", "claim_id").withColumn("shown", F.lit(True))
    here = samples.join(at, ["repo_id", "document_path"]).where((F.col("a") <= F.col("claim_line")) & (F.col("claim_line") <= F.col("b")) & (F.col("kind").isNull() | (F.col("kind") == F.col("drift_type"))) & (F.col("code").isNull() | (F.col("code") == F.col("code_path"))))
    said = F.when((F.col("decision") == "INCONSISTENT") & F.col("shown").isNull(), "UNCERTAIN").otherwise(F.col("decision"))
    folded = here.join(shown, ["repo_id", "claim_id"], "left").groupBy("sample_id").agg(metrics.fold_decisions(F.collect_set(said)).alias("prediction"))
    out = samples.join(folded, "sample_id", "left").join(report.status, "repo_id", "left")
    return out.select("sample_id", "group_id", F.lit(config.method).alias("method"), "drift_type", "gold", F.coalesce("prediction", F.lit("SKIPPED")).alias("prediction"), F.coalesce("status", F.lit("FAILED")).alias("status"))


def run(spark: SparkSession, manifest: str, out: str, method: str = "rules") -> dict:
    """Writes predictions.jsonl and metrics.json to a new folder and returns the metrics; samples of one state share its scan."""
    folder = Path(out)
    if folder.is_dir() and any(folder.iterdir()):
        raise SourceError("OUTPUT_EXISTS", out)
    listed = read_jsonl(spark, manifest, SAMPLES)
    states = [(r[0], r[1]) for r in listed.select("repo_path", "head_sha").distinct().collect()]
    if not states:
        raise SourceError("EMPTY_MANIFEST", manifest)
    samples = listed.withColumn("repo_id", F.concat("repo_path", F.lit("@"), "head_sha"))
    files = reduce(DataFrame.unionByName, [read_repository(spark, path, resolve_ref(path, sha), state_of(path, sha), suffixes=".py,.md") for path, sha in sorted(states)])
    found = predict(samples, files, Config(method=method)).orderBy("sample_id").collect()
    scored = spark.createDataFrame(found, "sample_id string, group_id string, method string, drift_type string, gold string, prediction string, status string")
    bad = metrics.violations(scored).count()
    told = metrics.overall(scored).first().asDict() | {"scans": scopes.scan_count(listed, "repo_path", "head_sha").first()["scans"], "method": method, "invalid_rows": bad}
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "predictions.jsonl").write_text("".join(json.dumps(r.asDict(), ensure_ascii=False) + "\n" for r in found), encoding="utf-8")
    (folder / "metrics.json").write_text(json.dumps(told, indent=2), encoding="utf-8")
    return told
