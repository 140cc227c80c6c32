"""Which facts a claim is about: dotted-suffix matches, as an equality join with aggregates over the suffixes of every fact's subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import written
from plumbline.functions.text import dotted_suffixes

CLAIM = ["repo_id", "claim_id"]


NAME = ["repo_id", "predicate", "subject"]


#: Up to so many different properties of claims filter the facts before anything is shuffled.
PROPERTIES = 1000


def _asked(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """facts of properties that claims are about, or all where those are too many to list; no other fact can match."""
    named = [r[0] for r in claims.select("predicate").where("predicate IS NOT NULL").distinct().limit(PROPERTIES + 1).collect()]
    return facts if len(named) > PROPERTIES else facts.where(F.col("property").isin(named))


def _tops(claims: DataFrame, facts: DataFrame, top_k: int) -> DataFrame:
    """NAME, hinted, path, exact, matches, ids: for each name that a claim uses the number and the first top_k ids of its facts.

    Once over all files (hinted false, path empty) and once for each file that a claim hints at. Names that no claim uses go first. A name has one row of each kind however many facts it has, so claims
    of a common name never meet its facts one by one; only numbers and top_k ids of each name leave the aggregation.
    """
    spelled = facts.select(F.col("repo_id"), F.col("property").alias("predicate"), F.explode(F.array_distinct(dotted_suffixes(F.col("subject")))).alias("subject"), F.col("subject").alias("own"), "fact_id", F.col("span.path").alias("at"))
    spelled = spelled.where("subject <> ''").select(*NAME, (F.col("own") == F.col("subject")).alias("exact"), "fact_id", F.coalesce("at", F.lit("")).alias("path"))
    mine = written(spelled.join(claims.select(NAME).distinct(), NAME, "left_semi"), "spelled")
    hints = claims.where("source_hint IS NOT NULL").select(*NAME, F.col("source_hint").alias("path")).distinct()
    kind = [*NAME, "hinted", "path", "exact"]
    spelled = mine.withColumn("path", F.lit("")).withColumn("hinted", F.lit(False)).unionByName(mine.join(hints, [*NAME, "path"], "left_semi").withColumn("hinted", F.lit(True)))
    first = spelled.withColumn("n", F.row_number().over(W.partitionBy(*kind).orderBy("fact_id"))).where(F.col("n") <= top_k)
    first = first.groupBy(*kind).agg(F.array_sort(F.collect_list("fact_id")).alias("ids"))
    return spelled.groupBy(*kind).agg(F.count(F.lit(1)).alias("matches")).join(first, kind)


def align(claims: DataFrame, facts: DataFrame, top_k: int = 5) -> DataFrame:
    """Rows of claims with fact (struct, null without a match), rank from 1, matches (their number before top_k) and reason.

    A claim's subject equals a fact's subject or its end from a dot on. Equal subjects rule out suffix matches; only then the claim's
    source hint applies. Ambiguity is counted over all matches, so top_k never makes one certain. A claim without a subject has none.
    Facts are told apart by repo_id and fact_id.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    facts = _asked(claims, facts)
    tops = written(_tops(claims, facts, top_k), "names")
    exact = tops.where("exact AND NOT hinted").select(*NAME, F.lit(True).alias("any_exact"))
    asked = claims.join(exact, NAME, "left").withColumn("any_exact", F.coalesce("any_exact", F.lit(False))).withColumn("hinted", F.col("source_hint").isNotNull()).withColumn("path", F.coalesce("source_hint", F.lit("")))
    found = asked.join(tops.withColumnRenamed("exact", "any_exact"), [*NAME, "any_exact", "hinted", "path"], "left")
    ranked = found.select(*claims.columns, F.coalesce("matches", F.lit(0)).alias("matches"), F.posexplode_outer("ids").alias("place", "_id"))
    whole = facts.select(F.col("repo_id").alias("_r"), F.col("fact_id").alias("_f"), F.struct(*facts.columns).alias("fact"))
    joined = ranked.join(whole, (F.col("repo_id") == F.col("_r")) & (F.col("_id") == F.col("_f")), "left")
    reason = F.when(F.col("matches") > 1, "AMBIGUOUS").when(F.col("matches") == 1, "MATCH").otherwise("NO_CANDIDATE")
    return joined.select(*claims.columns, "fact", (F.coalesce("place", F.lit(0)) + 1).alias("rank"), "matches", reason.alias("reason"))


def align_by_property(claims: DataFrame, facts: DataFrame, top_k: int = 5) -> DataFrame:
    """The ablation without ownership: the first top_k facts of the property, in the order of file and place; never ambiguous."""
    ordered = W.partitionBy("repo_id", "property").orderBy("span.path", "seq", "fact_id")
    facts = _asked(claims, facts)
    first = facts.select("repo_id", "property", F.struct(F.col("span.path").alias("path")).alias("span"), "seq", "fact_id").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top_k)
    first = written(first.select("repo_id", "fact_id", "rank"), "first")
    offered = facts.join(first, ["repo_id", "fact_id"]).select("repo_id", F.col("property").alias("predicate"), "rank", F.struct(*facts.columns).alias("fact"))
    joined = claims.join(offered, ["repo_id", "predicate"], "left")
    return joined.select(*claims.columns, "fact", F.coalesce("rank", F.lit(1)).alias("rank"), F.when(F.col("fact").isNotNull(), 1).otherwise(0).alias("matches"), F.lit("EXPERIMENT_NO_ALIGNMENT").alias("reason"))


def candidates(aligned: DataFrame) -> DataFrame:
    """Flat candidate rows: repo_id, claim_id, fact_id, rank, score, ambiguity, reason; claims without a match have none."""
    return aligned.where("fact IS NOT NULL").select(*CLAIM, F.col("fact.fact_id").alias("fact_id"), "rank", F.lit(1.0).alias("score"), (F.col("matches") > 1).alias("ambiguity"), "reason")
