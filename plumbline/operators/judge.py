"""Decisions over aligned claims, as Columns: a cascade of refusals, typed equality, and binding of calls to signatures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("DEFAULT_ASSERTION", "CONFIG_ASSERTION", "CALL_EXAMPLE")
BY_PLACE = ("POSITIONAL_ONLY", "POSITIONAL_OR_KEYWORD")


def _names(params: Column, *kinds: str, required: bool | None = None) -> Column:
    wanted = lambda p: p["kind"].isin(*kinds) if required is None else p["kind"].isin(*kinds) & (p["required"] == F.lit(required))
    return F.transform(F.filter(params, wanted), lambda p: p["name"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda p: p["kind"] == kind


def ordered_parameters(params: Column) -> Column:
    """Positional-only parameters before the others that go by place; each group in its own order."""
    return F.concat(*[F.filter(params, _of_kind(k)) for k in (*BY_PLACE, "VAR_POSITIONAL", "KEYWORD_ONLY", "VAR_KEYWORD")])


def with_call_reason(rows: DataFrame, params: Column, receiver: Column, known: Column, name: str = "call_reason") -> DataFrame:
    """rows with DYNAMIC_CALL, RECEIVER_UNKNOWN, CALL_ACCEPTED or CALL_BINDING_ERROR, by the rules of a real call.

    rows has positional_count, keyword_names, unpacking and bound_receiver. Each step is a projection of its own, so that no
    array is computed twice.
    """
    drops = (receiver == "class") | ((receiver == "instance") & F.col("bound_receiver"))
    out = rows.withColumn("_all", ordered_parameters(params)).withColumn("_drops", drops)
    out = out.withColumn("_stuck", F.col("_drops") & ~F.coalesce(F.get("_all", F.lit(0))["kind"].isin(*BY_PLACE), F.lit(False)))
    out = out.withColumn("_params", F.when(F.col("_drops") & ~F.col("_stuck"), F.slice("_all", 2, 2147483647)).otherwise(F.col("_all")))
    given = F.col("_params")
    out = out.withColumns({
        "_slots": F.filter(given, lambda p: p["kind"].isin(*BY_PLACE)),
        "_by_place": _names(given, "POSITIONAL_OR_KEYWORD"),
        "_by_name": _names(given, "POSITIONAL_OR_KEYWORD", "KEYWORD_ONLY"),
        "_need_place": _names(given, "POSITIONAL_ONLY", required=True),
        "_need_either": _names(given, "POSITIONAL_OR_KEYWORD", required=True),
        "_need_name": _names(given, "KEYWORD_ONLY", required=True),
        "_args": F.exists(given, _of_kind("VAR_POSITIONAL")),
        "_kwargs": F.exists(given, _of_kind("VAR_KEYWORD")),
    })
    count, keywords = F.col("positional_count"), F.col("keyword_names")
    out = out.withColumn("_filled", F.transform(F.filter("_slots", lambda p, i: i < count), lambda p: p["name"]))
    filled = F.col("_filled")
    accepted = (
        (F.size(F.array_distinct(keywords)) == F.size(keywords))
        & ((count <= F.size("_slots")) | F.col("_args"))
        & (F.size(F.array_intersect(keywords, F.array_intersect(filled, F.col("_by_place")))) == 0)
        & (F.col("_kwargs") | (F.size(F.array_except(keywords, F.col("_by_name"))) == 0))
        & (F.size(F.array_except("_need_place", filled)) == 0)
        & (F.size(F.array_except("_need_either", F.concat(filled, keywords))) == 0)
        & (F.size(F.array_except("_need_name", keywords)) == 0)
    )
    reason = F.when(~known | F.col("unpacking") | count.isNull(), "DYNAMIC_CALL").when(F.col("_stuck"), "RECEIVER_UNKNOWN").when(accepted, "CALL_ACCEPTED").otherwise("CALL_BINDING_ERROR")
    return out.select(*rows.columns, reason.alias(name))


def reason_code() -> Column:
    """The reason over the columns of an aligned claim with its first fact and call_reason."""
    fact, value = F.col("fact"), F.col("value")
    known = fact["value_state"] == "KNOWN"
    same = (fact["typed_value"]["type"] == value["type"]) & (fact["typed_value"]["canonical"] == value["canonical"])
    return (
        F.when(~F.col("kind").isin(*KINDS), "UNSUPPORTED_CLAIM")
        .when(F.col("version_scope") != "current", "VERSION_UNRESOLVED")
        .when(F.size("qualifiers") > 0, "QUALIFIED_ASSERTION")
        .when(F.col("matches") > 1, "AMBIGUOUS")
        .when(fact.isNull(), "NO_CANDIDATE")
        .when((F.col("kind") == "CALL_EXAMPLE") & (fact["fact_kind"] == "SIGNATURE"), F.col("call_reason"))
        .when(~known | fact["typed_value"].isNull() | value.isNull(), "UNKNOWN_VALUE")
        .when(same, "LITERAL_EQUAL")
        .otherwise("LITERAL_MISMATCH")
    )


def decision_of(reason: Column) -> Column:
    return F.when(reason == "UNSUPPORTED_CLAIM", "SKIPPED").when(reason.isin("LITERAL_EQUAL", "CALL_ACCEPTED"), "CONSISTENT").when(reason.isin("LITERAL_MISMATCH", "CALL_BINDING_ERROR"), "INCONSISTENT").otherwise("UNCERTAIN")


def judge(aligned: DataFrame) -> DataFrame:
    """Aligned claims, one row each, with decision, reason_code and fact_ids (the fact that was compared)."""
    fact = F.col("fact")
    first = with_call_reason(aligned.where("rank = 1"), fact["parameters"], fact["receiver"], fact["value_state"] == "KNOWN")
    judged = first.withColumn("reason_code", reason_code()).drop("call_reason")
    cites = F.col("reason_code").isin("LITERAL_EQUAL", "LITERAL_MISMATCH", "CALL_ACCEPTED", "CALL_BINDING_ERROR", "DYNAMIC_CALL", "RECEIVER_UNKNOWN")
    ids = F.when(cites, F.array("fact.fact_id")).otherwise(F.array().cast("array<string>"))
    return judged.withColumn("decision", decision_of(F.col("reason_code"))).withColumn("fact_ids", ids)


class Provider(Protocol):
    """A judge besides the rules; returns decision, reason and cited fact ids for a claim and its facts, both plain dicts."""

    def judge(self, claim: dict, facts: list[dict]) -> dict: ...


def wait_seconds(attempt: int) -> int:
    return min(2**attempt, 4)


@dataclass
class Retrying:
    """A provider that asks again after ConnectionError or TimeoutError, waiting longer each time, attempts times in all."""

    provider: Provider
    attempts: int = 3
    sleep: Callable[[float], None] = time.sleep

    def judge(self, claim: dict, facts: list[dict]) -> dict:
        for attempt in range(self.attempts):
            try:
                return self.provider.judge(claim, facts)
            except (ConnectionError, TimeoutError):
                if attempt == self.attempts - 1:
                    raise
                self.sleep(wait_seconds(attempt))
        raise ValueError("attempts must be at least 1")


def with_answers(judged: DataFrame, answers: DataFrame) -> DataFrame:
    """judged with decision, reason_code and fact_ids of answers where there is one; only the first candidate may carry a conflict."""
    said = answers.select("repo_id", "claim_id", F.struct("decision", "reason_code", "fact_ids").alias("_said"))
    joined = judged.join(said, ["repo_id", "claim_id"], "left")
    return joined.select(*[F.coalesce(F.col(f"_said.{c}"), F.col(c)).alias(c) if c in ("decision", "reason_code", "fact_ids") else F.col(c) for c in judged.columns])


def judge_with_provider(aligned: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """repo_id, claim_id, decision, reason_code, fact_ids by an external judge; answers that cite other facts are refused.

    make() is called in each Python worker, so connections and budgets are the worker's own. Any fault is an UNCERTAIN row, never a lost one.
    """
    claim = ["claim_id", "subject", "predicate", "kind", "quote"]
    sets = aligned.groupBy("repo_id", *claim).agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", F.col("fact.fact_id").alias("fact_id"), F.col("fact.subject").alias("subject"), F.col("fact.expression").alias("expression"))))).alias("facts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        provider = make()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                facts = [f for f in json.loads(row["facts"]) if f.get("fact_id")]
                try:
                    said = provider.judge({k: row[k] for k in claim}, facts)
                    if said["decision"] not in ("CONSISTENT", "INCONSISTENT", "UNCERTAIN") or not set(said["fact_ids"]) <= {f["fact_id"] for f in facts}:
                        raise ValueError("INVALID_RESPONSE")
                    out.append((row["repo_id"], row["claim_id"], said["decision"], said["reason_code"], list(said["fact_ids"])))
                except Exception as e:  # whatever an external judge does, its claim stays undecided
                    out.append((row["repo_id"], row["claim_id"], "UNCERTAIN", str(e)[:80] or type(e).__name__, []))
            yield pd.DataFrame(out, columns=["repo_id", "claim_id", "decision", "reason_code", "fact_ids"])

    return sets.mapInPandas(run, "repo_id string, claim_id string, decision string, reason_code string, fact_ids array<string>")
