"""Quality metrics of predictions, their validity, recall of alignments, and the checks on a benchmark's samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.tables import in_order
from plumbline.functions.text import ratio

DEFINITE, ABSTAINED = ("INCONSISTENT", "CONSISTENT"), ("UNCERTAIN", "SKIPPED")
GOLD = (*DEFINITE, "INSUFFICIENT")


def counts() -> list[Column]:
    """Aggregates over gold, prediction and status. Rows of INSUFFICIENT gold are outside the confusion matrix."""
    gold, said = F.col("gold"), F.col("prediction")
    positive, decidable = said == "INCONSISTENT", gold != "INSUFFICIENT"
    n = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count(F.lit(1)).alias("sample_count"),
        n((gold == "INCONSISTENT") & positive, "tp"),
        n((gold == "CONSISTENT") & positive, "fp"),
        n((gold == "CONSISTENT") & ~positive, "tn"),
        n((gold == "INCONSISTENT") & ~positive, "fn"),
        n(decidable, "decidable"),
        n(decidable & said.isin(*DEFINITE), "decided"),
        n(~decidable, "insufficient"),
        n(~decidable & positive, "improper_confirmation"),
        n(F.col("status") == "FAILED", "failed"),
        n(said.isin(*ABSTAINED), "abstained"),
        n((gold == "CONSISTENT") & (said == "CONSISTENT"), "explicit"),
        n(gold == "CONSISTENT", "consistent"),
        n(F.col("status") == "COMPLETED", "completed"),
    ]


def with_ratios(counted: DataFrame) -> DataFrame:
    """Counts with their ratios; a ratio over nothing is null, never perfect."""
    c = F.col
    pairs = {
        "precision": (c("tp"), c("tp") + c("fp")),
        "recall": (c("tp"), c("tp") + c("fn")),
        "f1": (2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "false_positive_rate": (c("fp"), c("fp") + c("tn")),
        "decision_coverage": (c("decided"), c("decidable")),
        "abstention_rate": (c("abstained"), c("sample_count")),
        "improper_confirmation_rate": (c("improper_confirmation"), c("insufficient")),
        "explicit_consistency_rate": (c("explicit"), c("consistent")),
        "complete_run_rate": (c("completed"), c("sample_count")),
    }
    return counted.withColumns({name: ratio(a, b) for name, (a, b) in pairs.items()}).drop("explicit", "consistent", "completed")


def overall(predictions: DataFrame) -> DataFrame:
    return with_ratios(predictions.agg(*counts()))


def grouped(predictions: DataFrame, *by: str) -> DataFrame:
    """Metrics of the whole and of each value of each column, in one pass; level names the column (all for the whole), key its value."""
    sets = [[], *[[F.col(b)] for b in by]]
    named = predictions.groupingSets(sets, *[F.col(b) for b in by]).agg(F.grouping_id().alias("gid"), *counts())
    full = (1 << len(by)) - 1
    level, key = F.lit("all"), F.lit(None).cast("string")
    for i, b in enumerate(by):
        hit = F.col("gid") == (full & ~(1 << (len(by) - 1 - i)))
        level, key = F.when(hit, b).otherwise(level), F.when(hit, F.col(b).cast("string")).otherwise(key)
    return with_ratios(named.withColumn("level", level).withColumn("key", key).drop("gid", *by))


def violations(predictions: DataFrame) -> DataFrame:
    """sample_id, violation: rows that no metric may be computed from."""
    many = F.count(F.lit(1)).over(W.partitionBy("sample_id")) > 1
    checks = F.array_compact(F.array(
        F.when(F.col("sample_id").isNull() | (F.col("sample_id") == ""), "EMPTY_ID"),
        F.when(F.col("duplicate"), "DUPLICATE_ID"),
        F.when(~F.coalesce(F.col("gold").isin(*GOLD), F.lit(False)), "UNKNOWN_GOLD"),
        F.when(~F.coalesce(F.col("prediction").isin(*DEFINITE, *ABSTAINED), F.lit(False)), "UNKNOWN_PREDICTION"),
        F.when(~F.coalesce(F.col("status").isin("COMPLETED", "PARTIAL", "FAILED"), F.lit(False)), "UNKNOWN_STATUS"),
        F.when((F.col("status") == "FAILED") & F.col("prediction").isin(*DEFINITE), "FAILED_BUT_DEFINITE"),
    ))
    return predictions.withColumn("duplicate", many).select("sample_id", F.explode(checks).alias("violation"))


def fold_decisions(decisions: Column) -> Column:
    """One decision of a set: all alike, else UNCERTAIN; SKIPPED of none."""
    kinds = F.array_distinct(decisions)
    return F.when(F.size(kinds) == 0, "SKIPPED").when((F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin(*DEFINITE), F.get(kinds, F.lit(0))).otherwise("UNCERTAIN")


def split_leakage(samples: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split."""
    return samples.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def interval_overlaps(intervals: DataFrame, keys: list[str], identity: str, start: str, end: str) -> DataFrame:
    """left_id < right_id of intervals (ends included) that overlap within equal keys."""
    a = intervals.select(*keys, F.col(identity).alias("left_id"), F.col(start).alias("s1"), F.col(end).alias("e1"))
    b = intervals.select(*keys, F.col(identity).alias("right_id"), F.col(start).alias("s2"), F.col(end).alias("e2"))
    return a.join(b, keys).where("left_id < right_id AND s1 <= e2 AND s2 <= e1").select(*keys, "left_id", "right_id")


def recall_at(targets: DataFrame, ks: list[int]) -> DataFrame:
    """k, hits, targets, recall from targets with min_rank (null for a miss, missing reports included); excluded ones must be left out before."""
    if not ks or min(ks) < 1 or len(set(ks)) < len(ks):
        raise ValueError("ks must be different positive numbers")
    columns = [F.count_if(F.col("min_rank") <= k).alias(f"k{k}") for k in ks]
    row = targets.agg(F.count(F.lit(1)).alias("targets"), *columns)
    long = row.select("targets", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks])).alias("r"))
    return long.select("r.k", "r.hits", "targets", ratio(F.col("r.hits"), F.col("targets")).alias("recall"))


def run_status(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: PARTIAL if any diagnostic says that something wasn't read."""
    return diagnostics.groupBy(*keys).agg(F.when(F.bool_or("affects_completeness"), "PARTIAL").otherwise("COMPLETED").alias("status"))


def exit_code(status: Column, confirmed: Column, fail_on: str = "confirmed", require_complete: bool = False) -> Column:
    """0 well, 1 confirmed conflicts, 2 a failed run, 3 an incomplete one where completeness is asked for."""
    out = F.when(status == "FAILED", 2)
    if require_complete:
        out = out.when(status != "COMPLETED", 3)
    if fail_on == "confirmed":
        out = out.when(confirmed > 0, 1)
    return out.otherwise(0)


def over_cap(samples: DataFrame, group: str, most: int) -> DataFrame:
    """Groups with more samples than allowed."""
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") > most)


def request_bound(samples: DataFrame, methods: int, most: int) -> DataFrame:
    """The most requests that a suite may send: samples times methods that ask a model times requests of a scan."""
    return samples.agg((F.count(F.lit(1)) * methods * most).alias("requests"))


def reserve(requests: DataFrame, keys: list[str], order: str, cost: str, most_requests: int, most_tokens: int) -> DataFrame:
    """requests with granted: in order, each takes one request and its cost if both still fit; a refused one takes nothing."""

    def start() -> Callable[[int], bool]:
        n = used = 0

        def take(c: int) -> bool:
            nonlocal n, used
            ok = n < most_requests and used + c <= most_tokens
            n, used = n + ok, used + c * ok
            return ok

        return take

    return requests.join(in_order(requests, keys, order, cost, "granted", start), [*keys, order])


def recheck(saved: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric: saved values that a new computation doesn't confirm, rows that only one side has included."""
    values = [c for c in saved.columns if c not in keys]
    a, b = saved.select(*keys, F.struct(*values).alias("a")), computed.select(*keys, F.struct(*values).alias("b"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")), v) for v in values]))
    return a.join(b, keys, "full_outer").select(*keys, F.explode(differs).alias("metric"))


def compare_methods(runs: DataFrame, method: str, status: str, states: list[str], usage: str, digits: int = 2) -> DataFrame:
    """method, a count for each of states, and usage: one row for each method, in one aggregation."""
    counts_of = [F.count_if(F.col(status) == s).alias(s) for s in states]
    return runs.groupBy(method).agg(*counts_of, F.round(F.sum(F.col(usage).cast("decimal(18,4)")), digits).cast("double").alias("usage"))


def suite_issues(plans: DataFrame, key: str = "suite_id") -> DataFrame:
    """key, issue of suites that mustn't be run: samples that aren't adjudicated, repeated methods, cached answers, a budget under the bound.

    plans: key, methods (array), statuses (array of the samples' annotation), cached, requests (the bound) and budget.
    """
    checks = [
        F.when(F.exists("statuses", lambda x: ~x.eqNullSafe(F.lit("adjudicated"))), "NOT_ADJUDICATED"),
        F.when((F.size("methods") == 0) | (F.size(F.array_distinct("methods")) < F.size("methods")), "METHODS"),
        F.when(F.col("cached"), "CACHED"),
        F.when(F.col("requests") > F.col("budget"), "BUDGET"),
    ]
    return plans.select(key, F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def wait_seconds(attempt: Column) -> Column:
    """Seconds before the next try of a request, doubled each time up to four."""
    return F.least(F.pow(F.lit(2), attempt), F.lit(4.0)).cast("int")
