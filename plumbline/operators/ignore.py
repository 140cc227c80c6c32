"""Suppression rules over findings: the first rule in force that fits wins; an expired one only leaves its reason and date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import glob_regex


@dataclass(frozen=True)
class Rule:
    reason: str
    path: str = "**/*.md"
    finding_id: str | None = None
    rule_id: str | None = None
    expires: date | None = None


def _table(rules: list[Rule]) -> Column:
    text = lambda x: F.lit(x).cast("string")
    rows = [F.struct(text(r.finding_id).alias("finding_id"), text(r.rule_id).alias("rule_id"), text(glob_regex(r.path)).alias("regex"), text(r.reason).alias("reason"), F.lit(r.expires).cast("date").alias("expires")) for r in rules]
    return F.array(*rows) if rows else F.array().cast("array<struct<finding_id:string,rule_id:string,regex:string,reason:string,expires:date>>")


def apply_rules(findings: DataFrame, rules: list[Rule], scan_date: date, path: Column | None = None, rule_id: Column | None = None) -> DataFrame:
    """findings with ignored, ignore_reason and ignore_expires. A rule is expired from the day after its date on.

    The rules are configuration: they go into the plan as one literal array, so nothing is joined.
    """
    path = F.col("evidence.document.path") if path is None else path
    rule_id = F.col("evidence.rule_id") if rule_id is None else rule_id
    today = F.lit(scan_date).cast("date")
    fits = lambda r: (r["finding_id"].isNull() | (r["finding_id"] == F.col("finding_id"))) & (r["rule_id"].isNull() | (r["rule_id"] == F.col("_rule"))) & F.regexp_like(F.col("_path"), r["regex"])
    expired = lambda r: F.coalesce(r["expires"] < today, F.lit(False))
    marked = findings.withColumn("_path", path).withColumn("_rule", rule_id).withColumn("_fits", F.filter(_table(rules), fits))
    marked = marked.withColumn("_force", F.get(F.filter("_fits", lambda r: ~expired(r)), F.lit(0))).withColumn("_gone", F.get(F.filter("_fits", expired), F.lit(0)))
    used = F.coalesce("_force", "_gone")
    return marked.select(*findings.columns, F.col("_force").isNotNull().alias("ignored"), used["reason"].alias("ignore_reason"), used["expires"].alias("ignore_expires"))


def status_text() -> Column:
    """One of four sentences about a finding's suppression."""
    reason = F.coalesce("ignore_reason", F.lit("not given"))
    until = F.col("ignore_expires").cast("string")
    return (
        F.when(F.col("ignored") & until.isNull(), F.concat(F.lit("ignored without a deadline; reason: "), reason))
        .when(F.col("ignored"), F.concat(F.lit("ignored until "), until, F.lit("; reason: "), reason))
        .when(until.isNotNull(), F.concat(F.lit("not ignored, the rule expired on "), until, F.lit("; reason: "), reason))
        .otherwise("not ignored")
    )
