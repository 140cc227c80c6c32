"""Annotation reviews and benchmark scopes: two reviewers side by side, coordinates, overlap with development data, claim scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import line_coordinate
from plumbline.operators.metrics import fold_decisions


def differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, issue: samples that one review lacks, and columns in which the two differ (null equals null)."""
    joined = a.select(key, F.struct(*columns).alias("a")).join(b.select(key, F.struct(*columns).alias("b")), key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    issues = [F.when(F.col("b").isNull(), "ONLY_IN_FIRST"), F.when(F.col("a").isNull(), "ONLY_IN_SECOND"), *[F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"DIFFERS:{c}") for c in columns]]
    return joined.select(key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def field_issues(reviews: DataFrame, key: str, required: list[str], labels: dict[str, tuple[str, ...]], lines: dict[str, Column]) -> DataFrame:
    """key, issue: empty required fields, labels out of their sets, line coordinates that are none or pass the file's end."""
    checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"EMPTY:{c}") for c in required]
    checks += [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), f"LABEL:{c}") for c, allowed in labels.items()]
    checks += [F.when(line_coordinate(F.col(c)).isNull() | (line_coordinate(F.col(c))["last"] > last), f"LINES:{c}") for c, last in lines.items()]
    return reviews.select(key, F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def shared_with(samples: DataFrame, development: DataFrame, *keys: str) -> DataFrame:
    """Samples that development data has as well, by equal keys: must be empty."""
    return samples.join(development.select(*keys).distinct(), list(keys), "left_semi")


def contained(claims: DataFrame, ranges: DataFrame, keys: list[str], position: tuple[str, str] = ("start_line", "end_line")) -> DataFrame:
    """claims that lie wholly within a range (start, end) of equal keys, once each."""
    within = (F.col("r.start") <= F.col(f"c.{position[0]}")) & (F.col(f"c.{position[1]}") <= F.col("r.end"))
    on = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys]
    condition = within
    for o in on:
        condition = condition & o
    return claims.alias("c").join(ranges.alias("r"), condition, "left_semi")


def scoped_prediction(claims: DataFrame, sample: str, decision: str) -> DataFrame:
    """sample, prediction: the decisions of a sample's claims folded into one."""
    return claims.groupBy(sample).agg(fold_decisions(F.collect_set(decision)).alias("prediction"))


def keyword_pairs(code: DataFrame, docs: DataFrame, key: str, code_text: str, doc_text: str) -> DataFrame:
    """key, prediction of a baseline without syntax: name = value in code against names with stated values in documents."""
    assigned = code.select(key, F.explode(F.regexp_extract_all(F.col(code_text), F.lit(r"\b[A-Za-z_]\w*\s*=\s*[^,)\n#]+"), F.lit(0))).alias("m"))
    assigned = assigned.select(key, F.lower(F.regexp_extract("m", r"^([A-Za-z_]\w*)", 1)).alias("name"), F.trim(F.regexp_extract("m", r"(?s)=\s*(.*)$", 1)).alias("value"))
    says, stated = r"\s*(?:=|默认值?为|defaults?\s+to)\s*`?", r"[^\s`,;。)]+"
    said = docs.select(key, F.explode(F.regexp_extract_all(F.col(doc_text), F.lit(rf"(?i)\b[A-Za-z_]\w*`?{says}{stated}"), F.lit(0))).alias("m"))
    said = said.select(key, F.lower(F.regexp_extract("m", r"^([A-Za-z_]\w*)", 1)).alias("name"), F.rtrim(F.regexp_extract("m", rf"(?i){says}({stated})$", 1), F.lit(".")).alias("stated"))
    differs = said.join(assigned, [key, "name"]).groupBy(key).agg(F.bool_or(F.col("stated") != F.col("value")).alias("differs"))
    return docs.select(key).distinct().join(differs, key, "left").select(key, F.when(F.col("differs").isNull(), "SKIPPED").when(F.col("differs"), "INCONSISTENT").otherwise("CONSISTENT").alias("prediction"))
