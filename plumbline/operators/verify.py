"""Conflicts are published only if both sides are found again in the files themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import stable_id_column
from plumbline.functions.tables import written
from plumbline.operators.align import align
from plumbline.operators.judge import judge


def span_of(path: Column, content: Column, start: Column, end: Column) -> Column:
    """The span that these bytes have, with lines counted anew."""
    lines = lambda upto: (F.length(F.translate(F.decode(F.substring(content, F.lit(1), upto.cast("int")), "ISO-8859-1"), "\n", "")) * -1 + F.length(F.substring(content, F.lit(1), upto.cast("int"))) + 1).cast("int")
    return F.struct(path.alias("path"), lines(start).alias("start_line"), lines(F.greatest(start, end - 1)).alias("end_line"), start.alias("start_byte"), end.alias("end_byte"), F.sha2(content, 256).alias("blob_hash"))


def span_holds(span: Column, content: Column, quote: Column | None) -> Column:
    """A span lies within its file, has its lines and hash right, and covers just the quote (if one is given)."""
    inside = content.isNotNull() & (span["start_byte"] >= 0) & (span["end_byte"] <= F.length(content))
    same = span_of(span["path"], content, span["start_byte"], span["end_byte"]) == span
    if quote is not None:
        same = same & (F.substring(content, (span["start_byte"] + 1).cast("int"), (span["end_byte"] - span["start_byte"]).cast("int")) == quote.cast("binary"))
    return F.coalesce(inside & same, F.lit(False))


def verify(judged: DataFrame, files: DataFrame, fresh_claims: DataFrame, fresh_facts: DataFrame) -> DataFrame:
    """Rows of judged that say INCONSISTENT, with reject: null for a proven conflict, else the first reason against it.

    INVALID_REFERENCE, EVIDENCE_MISMATCH, REEXTRACTION_MISMATCH, CONFLICT_NOT_PROVEN, in this order. fresh_claims and fresh_facts are a second,
    independent extraction of the same files. Places of evidence meet the files in one join, blobs travel no further than that. The result is
    written, as the inputs of the tables that follow.
    """
    claim_columns = [c for c in fresh_claims.columns if c in judged.columns]
    doubted = written(judged.where("decision = 'INCONSISTENT'"), "doubted")
    doubted = doubted.withColumn("reference", F.when((F.size("fact_ids") == 1) & (F.col("fact.fact_id") == F.get("fact_ids", F.lit(0))), F.col("fact")))
    place = lambda rows, span, quote: rows.select("repo_id", "claim_id", span.alias("place"), (quote if quote is not None else F.lit(None).cast("string")).alias("said"), F.lit(quote is not None).alias("quoted"))
    links = doubted.select("repo_id", "claim_id", F.explode("reference.provenance").alias("link"))
    places = place(doubted, F.col("span"), F.col("quote")).union(place(doubted.where("reference IS NOT NULL"), F.col("reference.span"), F.col("reference.expression"))).union(place(links, F.col("link"), None))
    blob = files.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), F.col("content").alias("_content"))
    held = F.when(F.col("quoted"), span_holds(F.col("place"), F.col("_content"), F.col("said"))).otherwise(span_holds(F.col("place"), F.col("_content"), None))
    broken = places.join(blob, (F.col("repo_id") == F.col("_r")) & (F.col("place.path") == F.col("_p")), "left").where(~held).select("repo_id", "claim_id").distinct().withColumn("broken", F.lit(True))
    checked = doubted.join(broken, ["repo_id", "claim_id"], "left").withColumn("evidence", F.col("broken").isNull()).drop("broken")
    again = fresh_claims.select("repo_id", "claim_id", F.struct(*claim_columns).alias("fresh_claim"))
    facts_again = fresh_facts.select(F.col("repo_id").alias("_r"), F.col("fact_id").alias("_id"), F.struct(*fresh_facts.columns).alias("fresh_fact"))
    checked = checked.join(again, ["repo_id", "claim_id"], "left").join(facts_again, (F.col("repo_id") == F.col("_r")) & (F.col("reference.fact_id") == F.col("_id")), "left").drop("_r", "_id")
    mine = F.struct(*claim_columns)
    refound = F.coalesce(mine.eqNullSafe(F.col("fresh_claim")) & F.col("reference").eqNullSafe(F.col("fresh_fact")), F.lit(False))
    proven = judge(align(fresh_claims.join(doubted.select("repo_id", "claim_id"), ["repo_id", "claim_id"], "left_semi"), fresh_facts))
    proven = proven.select("repo_id", "claim_id", F.col("decision").alias("fresh_decision"), F.col("fact_ids").alias("fresh_ids"))
    checked = checked.join(proven, ["repo_id", "claim_id"], "left")
    agreed = F.coalesce((F.col("fresh_decision") == "INCONSISTENT") & (F.col("fresh_ids") == F.col("fact_ids")), F.lit(False))
    reject = F.when(F.col("reference").isNull(), "INVALID_REFERENCE").when(~F.col("evidence"), "EVIDENCE_MISMATCH").when(~refound, "REEXTRACTION_MISMATCH").when(~agreed, "CONFLICT_NOT_PROVEN")
    return written(checked.select(*judged.columns, reject.alias("reject")), "verified")


def findings(verified: DataFrame, head_sha: str | Column, snapshot_hash: Column | None = None) -> DataFrame:
    """Published conflicts with their stable ids and both spans as evidence."""
    head = F.lit(head_sha) if isinstance(head_sha, str) else head_sha
    rule = F.concat("fact.fact_kind", F.lit("/1"))
    finding = stable_id_column(rule, F.col("span.path"), F.col("subject"), F.col("predicate"), F.col("quote"), F.col("claim_id"), head)
    evidence = F.struct(head.alias("head_sha"), (snapshot_hash if snapshot_hash is not None else F.lit(None).cast("string")).alias("snapshot_hash"), F.col("fact.entity_id").alias("entity_id"), F.col("span").alias("document"), F.col("fact.span").alias("code"), F.col("fact.provenance").alias("code_provenance"), rule.alias("rule_id"), F.lit("verifier/1").alias("verifier_version"))
    return verified.where("reject IS NULL").select("repo_id", finding.alias("finding_id"), F.col("fact.fact_kind").alias("drift_type"), "claim_id", "fact_ids", evidence.alias("evidence"), F.lit("HIGH").alias("severity"), F.lit("OPEN").alias("status"), F.lit("VERIFIED").alias("verification_status"), F.col("value_span"), F.col("fact.expression").alias("expression"), "subject", "predicate", "quote")


def rejected(verified: DataFrame) -> DataFrame:
    return verified.where("reject IS NOT NULL").select("repo_id", "claim_id", F.col("reject").alias("reason"), F.lit("UNCERTAIN").alias("decision"))
