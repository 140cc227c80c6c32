"""Queries over finished reports: records of findings and open judgments, filters, pages, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = 12


def category(ignored: Column, verification: Column, decision: Column) -> Column:
    """ignored, confirmed, uncertain, unverified or other."""
    return F.when(ignored, "ignored").when(verification == "VERIFIED", "confirmed").when(decision == "UNCERTAIN", "uncertain").when(verification.isNotNull(), "unverified").otherwise("other")


def records(findings: DataFrame, judgments: DataFrame, key: str = "claim_id") -> DataFrame:
    """Findings, and the judgments that no finding speaks for; both need the same columns besides kind."""
    open_ = judgments.join(findings.select(key), key, "left_anti")
    return findings.withColumn("kind", F.lit("finding")).unionByName(open_.withColumn("kind", F.lit("judgment")))


def last_by_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: the last one, in the place of the first."""
    columns = [c for c in rows.columns if c not in (key, position)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("row"), F.min(position).alias(position)).select(key, position, "row.*")


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(needle)))) if needle else rows


def page(rows: DataFrame, number: int, *order: Column, size: int = PAGE) -> DataFrame:
    """Rows of one page, counted from 0; a page beyond the last is the last."""
    total = rows.count()
    number = max(0, min(number, -(-total // size) - 1))
    return rows.orderBy(*order).offset(number * size).limit(size)


def section_count(section: Column) -> Column:
    """Null, not 0, of a section that a report doesn't have."""
    return F.when(section.isNull(), F.lit(None)).otherwise(F.size(section))


def uncertain_count(judgments: DataFrame, rejected: DataFrame, key: str = "claim_id") -> DataFrame:
    ids = judgments.where("decision = 'UNCERTAIN'").select(key).union(rejected.select(key))
    return ids.agg(F.count_distinct(key).alias("uncertain"))


def comparable(a: str, b: str) -> Column:
    """Two runs (struct columns) of one repository, state, mode, configuration and set of types, under different ids."""
    same = lambda f: F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    kinds = lambda x: F.array_sort(F.array_distinct(F.col(f"{x}.enabled_types")))
    return same("repo_id") & same("head_sha") & same("mode") & same("config_hash") & (kinds(a) == kinds(b)) & (F.col(f"{a}.run_id") != F.col(f"{b}.run_id"))


def upsert(reports: DataFrame, keys: list[str], arrived: str) -> DataFrame:
    newest = W.partitionBy(*keys).orderBy(F.col(arrived).desc())
    return reports.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """node, depth, files: each folder and file with the number of files in it."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.alias("depth")))
    return paths.select(F.explode(prefixes).alias("x")).groupBy("x.node", "x.depth").agg(F.count(F.lit(1)).alias("files"))


def diff_lines(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """keys, row, kind (hunk, file, add, remove, same, note), old_line, new_line, text of every line of unified diffs."""
    rows = diffs.select(*keys, F.posexplode(F.split(F.col(diff), "\n", -1)).alias("row", "text")).where("text <> ''")
    kind = F.when(F.col("text").rlike(r"^@@ "), "hunk").when(F.col("text").rlike(r"^(--- |\+\+\+ )"), "file").when(F.col("text").startswith("+"), "add").when(F.col("text").startswith("-"), "remove").when(F.col("text").startswith("\\"), "note").otherwise("same")
    rows = rows.withColumn("kind", kind)
    base = W.partitionBy(*keys).orderBy("row")
    start = lambda sign: F.last(F.when(F.col("kind") == "hunk", F.regexp_extract("text", rf"\{sign}(\d+)", 1).cast("int")), ignorenulls=True).over(base)
    rows = rows.withColumn("hunk", F.sum((F.col("kind") == "hunk").cast("int")).over(base)).withColumn("o", start("-")).withColumn("n", start("+"))
    inside = W.partitionBy(*keys, "hunk").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(inside), F.lit(0))
    return rows.select(*keys, "row", "kind", F.when(F.col("kind").isin("remove", "same"), F.col("o") + seen("remove", "same")).alias("old_line"), F.when(F.col("kind").isin("add", "same"), F.col("n") + seen("add", "same")).alias("new_line"), "text")


def snippet_lines(texts: DataFrame, keys: list[str], text: str, needle: str | Column, first: int = 1) -> DataFrame:
    """keys, line (numbered from first), content, hit: whether the line is the first to contain needle."""
    wanted = F.lit(needle) if isinstance(needle, str) else needle
    rows = texts.select(*keys, wanted.alias("_needle"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_at", "content"))
    has = F.when(F.contains("content", F.col("_needle")), F.col("_at"))
    rows = rows.withColumn("_first", F.min(has).over(W.partitionBy(*keys)))
    return rows.select(*keys, (F.col("_at") + first).alias("line"), "content", F.coalesce(F.col("_at") == F.col("_first"), F.lit(False)).alias("hit"))


def with_signature(records: DataFrame, facts: DataFrame, keys: list[str], kind: str, wanted: str, order: str, shown: str) -> DataFrame:
    """records with signature: shown of the first fact of the wanted kind with the same keys, null without one."""
    first = facts.where(F.col(kind) == wanted).groupBy(*keys).agg(F.min_by(shown, order).alias("signature"))
    return records.join(first, keys, "left")


def closed(comparable_runs: Column, after: str) -> Column:
    """A case is closed if the runs can be compared and the second is complete and finds nothing at all."""
    nothing = [F.col(f"{after}.{c}") == 0 for c in ("confirmed", "uncertain", "unverified")]
    return F.coalesce(comparable_runs & (F.col(f"{after}.status") == "COMPLETED") & nothing[0] & nothing[1] & nothing[2], F.lit(False))


def history(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, event, detail: what happened in a run, one row for each step that it has (snapshot, scan, patch, rescan)."""
    step = lambda n, event, detail: F.struct(F.lit(n).alias("step"), F.lit(event).alias("event"), detail.cast("string").alias("detail"))
    steps = F.array(step(1, "snapshot", F.col("head_sha")), step(2, "scan", F.col("status")), step(3, "patch", F.col("patch_id")), step(4, "rescan", F.col("rescan_status")))
    return runs.select(*keys, F.inline(F.filter(steps, lambda s: s["detail"].isNotNull())))


def positions(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """rows with position ("2 / 7") and count within equal keys."""
    w = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("of", n).withColumn("position", F.concat_ws(" / ", F.row_number().over(w.orderBy(*order)).cast("string"), n.cast("string")))


def display(kind: Column, canonical: Column) -> Column:
    """A typed value as people read it: None, True, False, else the JSON text of the value; null of none."""
    body = F.substring(canonical, F.length(kind) + 5, F.length(canonical) - F.length(kind) - 5)
    return F.when(kind == "NoneType", "None").when((kind == "bool") & (body == "true"), "True").when(kind == "bool", "False").otherwise(body)


def structure_issues(rows: DataFrame, key: str, required: list[str], intervals: list[tuple[str, str]], labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, issue: what a report must not hold before it is shown: empty fields, intervals that are none, unknown labels, repeated keys."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"EMPTY:{c}") for c in required]
    checks += [F.when((F.col(a) < 0) | (F.col(a) > F.col(b)) | F.col(a).isNull() | F.col(b).isNull(), f"INTERVAL:{a}") for a, b in intervals]
    checks += [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), f"LABEL:{c}") for c, allowed in labels.items()]
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("REPEATED").alias("issue"))
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("issue")).unionByName(twice)
