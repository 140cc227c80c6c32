"""Referential integrity: everything that should be empty, in one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import written


def duplicates(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(check).alias("check"), named.alias("id"))


def dangling(rows: DataFrame, keys: list[str], parents: DataFrame, check: str, label: list[str] | None = None) -> DataFrame:
    """Rows whose keys, under the same names, no parent has."""
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in label or keys])
    return rows.join(parents.select(*keys), keys, "left_anti").select(F.lit(check).alias("check"), named.alias("id"))


def report_violations(files: DataFrame, entities: DataFrame, facts: DataFrame, claims: DataFrame, judgments: DataFrame, findings: DataFrame) -> DataFrame:
    """check, id of every broken rule between the tables of a scan."""
    r = "repo_id"
    hashes = written(files.select(r, F.col("path").alias("path"), F.sha2("content", 256).alias("blob_hash")), "hashes")
    at = lambda t, i: t.select(r, i, F.col("span.path").alias("path"), F.col("span.blob_hash").alias("blob_hash"))
    links = facts.select(r, "fact_id", F.explode("provenance").alias("p")).select(r, "fact_id", F.col("p.path").alias("path"), F.col("p.blob_hash").alias("blob_hash"))
    cited = judgments.select(r, "claim_id", F.explode("fact_ids").alias("fact_id"))
    shown = findings.select(r, "finding_id", "claim_id", F.explode("fact_ids").alias("fact_id"), F.col("evidence.document").alias("document"), F.col("evidence.code").alias("code"))
    agrees = shown.join(claims.select(r, "claim_id", F.col("span").alias("cs")), [r, "claim_id"]).join(facts.select(r, "fact_id", F.col("span").alias("fs")), [r, "fact_id"]).where("document <> cs OR code <> fs")
    parts = [
        duplicates(hashes, [r, "path"], "file twice"),
        duplicates(entities, [r, "entity_id"], "entity twice"),
        duplicates(facts, [r, "fact_id"], "fact twice"),
        duplicates(claims, [r, "claim_id"], "claim twice"),
        duplicates(findings, [r, "finding_id"], "finding twice"),
        dangling(facts, [r, "entity_id"], entities, "fact without entity", [r, "fact_id"]),
        dangling(at(facts, "fact_id"), [r, "path", "blob_hash"], hashes, "stale fact", [r, "fact_id"]),
        dangling(links, [r, "path", "blob_hash"], hashes, "stale provenance", [r, "fact_id"]),
        dangling(at(claims, "claim_id"), [r, "path", "blob_hash"], hashes, "stale claim", [r, "claim_id"]),
        dangling(judgments, [r, "claim_id"], claims, "judgment without claim", [r, "claim_id"]),
        dangling(cited, [r, "fact_id"], facts, "judgment without fact", [r, "claim_id"]),
        dangling(shown, [r, "claim_id"], claims, "finding without claim", [r, "finding_id"]),
        dangling(shown, [r, "fact_id"], facts, "finding without fact", [r, "finding_id"]),
        agrees.select(F.lit("finding with other evidence").alias("check"), F.concat_ws("/", r, "finding_id").alias("id")),
    ]
    return reduce(DataFrame.unionByName, parts)
