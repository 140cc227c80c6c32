"""Scored samples: which claims and facts a sample means, what a scan says of them, and how high its targets are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import fold_decisions


def scoped_facts(samples: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """sample_id, fact_id: facts of a sample's entities in its code file, of its property and kind, that rest on all the places it asks for.

    samples: sample_id, repo_id, entity_names (array), code_path, predicate, drift_type, required_provenance (array of spans).
    """
    wanted = samples.select("sample_id", "repo_id", "code_path", "predicate", "drift_type", "required_provenance", F.explode("entity_names").alias("qualified_name"))
    owned = entities.select("repo_id", "entity_id", "qualified_name", F.col("span.path").alias("code_path"))
    known = facts.select("repo_id", "entity_id", "fact_id", F.col("property").alias("predicate"), F.col("fact_kind").alias("drift_type"), F.col("span.path").alias("code_path"), F.array_append("provenance", F.col("span")).alias("places"))
    joined = wanted.join(owned, ["repo_id", "qualified_name", "code_path"]).join(known, ["repo_id", "entity_id", "code_path", "predicate", "drift_type"])
    return joined.where(F.size(F.array_except("required_provenance", "places")) == 0).select("sample_id", "fact_id").distinct()


def scoped_claims(samples: DataFrame, claims: DataFrame) -> DataFrame:
    """sample_id, repo_id, claim_id: claims of a sample's document, subject and property that lie wholly in one of its line ranges."""
    ranges = samples.select("sample_id", "repo_id", F.col("document_path").alias("path"), "subject", "predicate", F.explode("document_ranges").alias("range"))
    lines = claims.select("repo_id", "claim_id", "subject", "predicate", F.col("span.path").alias("path"), F.col("span.start_line").alias("a"), F.col("span.end_line").alias("b"))
    return ranges.join(lines, ["repo_id", "path", "subject", "predicate"]).where("range.start <= a AND b <= range.end").select("sample_id", "repo_id", "claim_id").distinct()


def predictions(samples: DataFrame, entities: DataFrame, facts: DataFrame, claims: DataFrame, judgments: DataFrame, status: DataFrame) -> DataFrame:
    """sample_id, prediction, status: decisions of a sample's claims that cite one of its facts alone, folded into one.

    Without a claim it is SKIPPED; a failed run, a claim with other facts or without a decision makes it UNCERTAIN.
    """
    mine = scoped_claims(samples, claims)
    cited = mine.join(judgments.select("repo_id", "claim_id", "decision", F.get("fact_ids", F.lit(0)).alias("fact_id"), F.size("fact_ids").alias("n")), ["repo_id", "claim_id"], "left")
    sure = cited.join(scoped_facts(samples, entities, facts).withColumn("owned", F.lit(True)), ["sample_id", "fact_id"], "left")
    said = F.when((F.col("n") == 1) & F.col("owned"), F.col("decision")).otherwise("UNCERTAIN")
    folded = sure.groupBy("sample_id").agg(fold_decisions(F.collect_set(said)).alias("prediction"))
    out = samples.select("sample_id", "repo_id").join(folded, "sample_id", "left").join(status, "repo_id", "left")
    state = F.coalesce("status", F.lit("FAILED"))
    return out.select("sample_id", F.when(state == "FAILED", "UNCERTAIN").otherwise(F.coalesce("prediction", F.lit("SKIPPED"))).alias("prediction"), state.alias("status"))


TARGET = ["path", "subject", "property", "fact_kind", "start_line"]


def target_ranks(gold: DataFrame, claims: DataFrame, candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """sample_id, target (number), min_rank (null for a miss) of every target of gold, for metrics.recall_at.

    gold: sample_id, repo_id, document_path, claim_line, targets (array of TARGET). A sample whose place holds no claim, or several, misses all.
    """
    targets = gold.select("sample_id", "repo_id", "document_path", "claim_line", F.posexplode("targets").alias("target", "t"))
    at = claims.groupBy("repo_id", F.col("span.path").alias("document_path"), F.col("span.start_line").alias("claim_line")).agg(F.min("claim_id").alias("claim_id"), F.count(F.lit(1)).alias("here")).where("here = 1")
    named = facts.select("repo_id", "fact_id", F.col("span.path").alias("path"), "subject", "property", "fact_kind", F.col("span.start_line").alias("start_line"))
    offered = candidates.select("repo_id", "claim_id", "fact_id", "rank").join(named, ["repo_id", "fact_id"])
    ranks = targets.select("sample_id", "target", "repo_id", "document_path", "claim_line", *[F.col(f"t.{c}").alias(c) for c in TARGET]).join(at, ["repo_id", "document_path", "claim_line"]).join(offered, ["repo_id", "claim_id", *TARGET])
    best = ranks.groupBy("sample_id", "target").agg(F.min("rank").alias("min_rank"))
    return targets.select("sample_id", "target").join(best, ["sample_id", "target"], "left")


def scan_count(samples: DataFrame, *keys: str) -> DataFrame:
    """scans: different states that samples need a scan of, since samples of one state share it."""
    return samples.agg(F.count_distinct(F.struct(*keys)).alias("scans"))
