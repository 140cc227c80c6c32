"""Queries of the relational operators over the driver's tables, with independent SQL for each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.ids import git_blob_id, stable_id_column
from plumbline.operators import align as A
from plumbline.operators import ignore, integrity, metrics, review, snapshot, viewer


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", stable_id_column(F.lit("doc"), F.col("source"), F.col("text")).alias("stable_id"), git_blob_id(F.col("text").cast("binary")).alias("blob_id"))


STABLE_IDS = """
SELECT doc_id, left(sha256('["doc", ' || to_json(source) || ', ' || to_json(text) || ']'), 24) AS stable_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(e) for e in (".py", ".md", ".txt", "/x.py", ".md", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    odd = F.when(F.col("doc_id") % 31 == 0, "../").when(F.col("doc_id") % 37 == 0, "build/").when(F.col("doc_id") % 41 == 0, "a\\b/").otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.concat(odd, "lang", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ends).alias("path"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 43 == 0, "120000").otherwise("100644").alias("mode"), F.col("text").cast("binary").alias("content"))


_PATHS = """(SELECT doc_id, source AS repo_id, text, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 31 = 0 THEN '../' WHEN doc_id % 37 = 0 THEN 'build/' WHEN doc_id % 41 = 0 THEN 'a\\b/' ELSE '' END
  || lang || '/d' || lpad(doc_id::VARCHAR, 9, '0') || ['.py', '.md', '.txt', '/x.py', '.md', ''][doc_id % 6 + 1] AS path, CASE WHEN doc_id % 43 = 0 THEN '120000' ELSE '100644' END AS mode FROM documents)"""


def snapshot_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.admit(_files(spark, sf_dir).select("repo_id", "path", "size"), max_total=60_000)


SNAPSHOT_ADMIT = f"""
WITH RECURSIVE f AS (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS n FROM {_PATHS}),
w(repo_id, n, path, size, used, admitted) AS (
  SELECT repo_id, n, path, size, CASE WHEN size <= 60000 THEN size ELSE 0 END, size <= 60000 FROM f WHERE n = 1
  UNION ALL SELECT f.repo_id, f.n, f.path, f.size, w.used + CASE WHEN w.used + f.size <= 60000 THEN f.size ELSE 0 END, w.used + f.size <= 60000 FROM w JOIN f ON f.repo_id = w.repo_id AND f.n = w.n + 1)
SELECT repo_id, path, size, admitted FROM w"""


def snapshot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    verdict = snapshot.file_verdict(F.col("path"), F.col("size"), F.col("mode"), F.col("content"), include=["**/*.py", "**/*.md"], exclude=["de/*", "*/d00000000[1-3].??"], max_file=9_000)
    return files.select("doc_id", "path", F.coalesce(verdict, F.lit("READ")).alias("verdict"), X.module_name(F.col("path")).alias("module"))


SNAPSHOT_FILTER = f"""
SELECT doc_id, path, CASE WHEN NOT regexp_matches(path, '[^/]+\\.(py|md)$') THEN 'UNSUPPORTED' WHEN path LIKE 'build/%' THEN 'EXCLUDED' WHEN path LIKE 'de/%' OR regexp_matches(path, '/d00000000[1-3]\\...$') THEN 'EXCLUDED'
  WHEN path LIKE '../%' OR contains(path, '\\') THEN 'UNSAFE_PATH' WHEN mode = '120000' THEN 'SYMLINK' WHEN size > 9000 THEN 'FILE_TOO_LARGE' WHEN contains(text, chr(0)) THEN 'NOT_TEXT' ELSE 'READ' END AS verdict,
  replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM {_PATHS}"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    later = docs.where("doc_id % 13 <> 0").withColumn("hash", F.when(F.col("doc_id") % 10 == 0, F.lit("changed")).otherwise(F.col("hash")))
    return snapshot.changed_paths(docs.where("doc_id % 17 <> 0"), later, ["doc_id"], "hash")


SNAPSHOT_DIFF = """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'ADDED' WHEN doc_id % 13 = 0 THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM documents
WHERE NOT (doc_id % 17 = 0 AND doc_id % 13 = 0) AND (doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 10 = 0)"""


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.files_hash(read(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("blob_hash")))


SNAPSHOT_HASH = """
SELECT source AS repo_id, left(sha256('[' || string_agg('"d' || doc_id || ':' || sha256(text) || '"', ', ' ORDER BY 'd' || doc_id) || ']'), 24) AS files_hash FROM documents GROUP BY source"""


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.line_offsets(read(spark, sf_dir, "documents"), ["doc_id"], "text")


LINE_OFFSETS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, line::INT AS line, coalesce(sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte, strlen(x)::INT AS bytes FROM l"""


def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("line"), F.when(F.col("p_size") % 4 == 0, F.col("p_size") % 3 + 1).cast("int").alias("level"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("title"))
    return snapshot.heading_context(lines, ["doc"], 3).select("doc", "line", "context", "nearest")


HEADING_CONTEXT = """
WITH l AS (SELECT p_brand AS doc, p_partkey AS line, CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 END AS level, 'h' || p_partkey AS title FROM part),
h AS (SELECT * FROM l WHERE level IS NOT NULL),
o AS (SELECT l.doc, l.line, h.level, h.title, h.line AS at FROM l JOIN h ON h.doc = l.doc AND h.line <= l.line WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.doc = l.doc AND x.line > h.line AND x.line <= l.line AND x.level <= h.level))
SELECT l.doc, l.line, coalesce(string_agg(o.title, ' ' ORDER BY o.level), '') AS context, arg_max(o.title, o.level) AS nearest FROM l LEFT JOIN o ON o.doc = l.doc AND o.line = l.line GROUP BY l.doc, l.line"""


def asof_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events.select("event_id", "user_id", snapshot.as_of_binding(events, ["user_id"], ["ts", "event_id"], bought).alias("bound"))


ASOF_BINDING = "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound FROM events"


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts with dotted subjects from parts, and claims about them from brands and sizes."""
    p = read(spark, sf_dir, "part")
    k, name = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("."))
    facts = p.select(F.lit("r").alias("repo_id"), F.concat(F.lit("f"), F.lpad(k, 9, "0")).alias("fact_id"), F.concat_ws(".", F.concat(F.lit("m"), (F.col("p_partkey") % 97).cast("string")), name).alias("subject"), F.col("p_type").alias("property"), F.struct(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("path")).alias("span"), F.col("p_partkey").cast("int").alias("seq"))
    subject = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.substring_index(name, ".", -1)).otherwise(F.concat_ws(".", F.concat(F.lit("m"), (F.col("p_partkey") % 97).cast("string")), name))
    subject = F.when(F.col("p_partkey") % 41 == 0, "").otherwise(subject)
    claims = p.select(F.lit("r").alias("repo_id"), k.alias("claim_id"), subject.alias("subject"), F.col("p_type").alias("predicate"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("source_hint"))
    return claims, facts


_SYMBOLS = """
f AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS fact_id, 'm' || p_partkey % 97 || '.' || replace(p_name, ' ', '.') AS subject, p_type AS property, 's' || p_size % 3 AS path, p_partkey FROM part),
c AS (SELECT p_partkey::VARCHAR AS claim_id, CASE WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '.') WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', -1) ELSE 'm' || p_partkey % 97 || '.' || replace(p_name, ' ', '.') END AS subject,
  p_type AS predicate, CASE WHEN p_partkey % 4 = 0 THEN 's' || p_size % 3 END AS hint FROM part)"""


def align_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, facts = _symbols(spark, sf_dir)
    return A.align(claims, facts, 3).select("claim_id", F.col("fact.fact_id").alias("fact_id"), "rank", "matches", "reason")


ALIGN_CANDIDATES = f"""
WITH {_SYMBOLS},
m AS (SELECT c.claim_id, c.hint, f.*, f.subject = c.subject AS exact FROM c JOIN f ON f.property = c.predicate AND c.subject <> '' AND (f.subject = c.subject OR suffix(f.subject, '.' || c.subject))),
b AS (SELECT *, bool_or(exact) OVER (PARTITION BY claim_id) AS any_exact FROM m),
k AS (SELECT claim_id, fact_id, row_number() OVER (PARTITION BY claim_id ORDER BY fact_id) AS rank, count(*) OVER (PARTITION BY claim_id) AS matches FROM b WHERE (exact OR NOT any_exact) AND (hint IS NULL OR path = hint))
SELECT c.claim_id, k.fact_id, coalesce(k.rank, 1)::INT AS rank, coalesce(k.matches, 0) AS matches, CASE WHEN k.matches > 1 THEN 'AMBIGUOUS' WHEN k.matches = 1 THEN 'MATCH' ELSE 'NO_CANDIDATE' END AS reason FROM c LEFT JOIN k ON k.claim_id = c.claim_id AND k.rank <= 3 WHERE k.claim_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM k x WHERE x.claim_id = c.claim_id)"""


def align_property_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, facts = _symbols(spark, sf_dir)
    return A.align_by_property(claims, facts, 3).select("claim_id", F.col("fact.fact_id").alias("fact_id"), "rank")


ALIGN_PROPERTY_ONLY = f"""
WITH {_SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY path, p_partkey) AS rank FROM f)
SELECT claim_id, fact_id, rank::INT AS rank FROM c JOIN r ON property = predicate WHERE rank <= 3"""


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("finding_id"), F.concat(F.lit("docs/"), F.lower("o_orderstatus"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderpriority").alias("rule"))
    rules = [ignore.Rule("status", "docs/p/*.md", expires=date(1999, 12, 31)), ignore.Rule("urgent", rule_id="1-URGENT", expires=date(2000, 1, 1)), ignore.Rule("one", finding_id="17"), ignore.Rule("low", "docs/[fo]/1*.md", rule_id="5-LOW")]
    out = ignore.apply_rules(orders, rules, date(2000, 1, 1), F.col("path"), F.col("rule"))
    return out.select("finding_id", "ignored", "ignore_reason", F.col("ignore_expires").cast("string").alias("ignore_expires"))


IGNORE_RULES = """
WITH r(pos, reason, path, rule, id, expires) AS (VALUES (1, 'status', '^docs/p/.*\\.md$', NULL, NULL, DATE '1999-12-31'), (2, 'urgent', '\\.md$', '1-URGENT', NULL, DATE '2000-01-01'), (3, 'one', '\\.md$', NULL, '17', NULL), (4, 'low', '^docs/[fo]/1.*\\.md$', '5-LOW', NULL, NULL)),
f AS (SELECT o_orderkey::VARCHAR AS finding_id, 'docs/' || lower(o_orderstatus) || '/' || o_custkey || '.md' AS path, o_orderpriority AS rule FROM orders),
m AS (SELECT f.finding_id, r.*, r.expires IS NOT NULL AND r.expires < DATE '2000-01-01' AS gone FROM f JOIN r ON regexp_matches(f.path, r.path) AND (r.rule IS NULL OR r.rule = f.rule) AND (r.id IS NULL OR r.id = f.finding_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY gone, pos) AS n FROM m)
SELECT f.finding_id, coalesce(NOT b.gone, false) AS ignored, b.reason AS ignore_reason, b.expires::VARCHAR AS ignore_expires FROM f LEFT JOIN b ON b.finding_id = f.finding_id AND b.n = 1"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("affects_completeness"), F.col("value"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = metrics.run_status(_diagnostics(spark, sf_dir).where("value > 40 OR NOT affects_completeness"), ["user_id"])
    confirmed = F.when(F.col("user_id") % 5 == 0, 2).otherwise(0)
    status = status.withColumn("status", F.when(F.col("user_id") % 11 == 0, "FAILED").otherwise(F.col("status")))
    return status.select("user_id", "status", metrics.exit_code(F.col("status"), confirmed).alias("code"), metrics.exit_code(F.col("status"), confirmed, require_complete=True).alias("strict_code"))


RUN_STATUS = """
WITH s AS (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'FAILED' WHEN bool_or(event_type = 'error') THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM events WHERE value > 40 OR event_type <> 'error' GROUP BY user_id)
SELECT user_id, status, CASE WHEN status = 'FAILED' THEN 2 WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS code, CASE WHEN status = 'FAILED' THEN 2 WHEN status <> 'COMPLETED' THEN 3 WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS strict_code FROM s"""


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    judgments = e.select(F.col("user_id").alias("claim_id"), F.when(F.col("event_type") == "error", "UNCERTAIN").otherwise("CONSISTENT").alias("decision"))
    rejected = e.where("event_type = 'signup' AND value > 80").select(F.col("user_id").alias("claim_id"))
    found = e.agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") < 50)).alias("confirmed"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") >= 50)).alias("ignored"), F.max(viewer.section_count(F.lit(None).cast("array<int>"))).alias("patches"))
    return viewer.uncertain_count(judgments, rejected).crossJoin(found)


REPORT_COUNTS = """
SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error' OR (event_type = 'signup' AND value > 80)) AS uncertain, count(*) FILTER (event_type = 'purchase' AND value < 50) AS confirmed, count(*) FILTER (event_type = 'purchase' AND value >= 50) AS ignored, NULL::INT AS patches FROM events"""


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0")
    keyed = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct()
    return integrity.duplicates(items, ["l_orderkey", "l_linenumber"], "line twice").unionByName(integrity.dangling(keyed, ["o_orderkey"], orders, "line without order", ["o_orderkey", "l_linenumber"]))


INTEGRITY_VIOLATIONS = """
SELECT 'line twice' AS "check", l_orderkey || '/' || l_linenumber AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'line without order', l_orderkey || '/' || l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 50 <> 0)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    gold = F.when(n % 9 == 0, "INSUFFICIENT").when(F.col("quality") == 1, "CONSISTENT").otherwise("INCONSISTENT")
    status = F.when(n % 14 == 0, "FAILED").when(n % 5 == 0, "PARTIAL").otherwise("COMPLETED")
    said = F.when(n % 14 == 0, "UNCERTAIN").when((F.col("toxic") == 1) | (n % 4 == 0), "INCONSISTENT").when(n % 3 == 0, "SKIPPED").otherwise("CONSISTENT")
    return docs.select(n.cast("string").alias("sample_id"), gold.alias("gold"), said.alias("prediction"), status.alias("status"), F.col("lang").alias("drift_type"), F.col("source").alias("group_id"))


_PREDICTIONS = """p AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 9 = 0 THEN 'INSUFFICIENT' WHEN quality = 1 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS gold, CASE WHEN doc_id % 14 = 0 THEN 'FAILED' WHEN doc_id % 5 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
  CASE WHEN doc_id % 14 = 0 THEN 'UNCERTAIN' WHEN toxic = 1 OR doc_id % 4 = 0 THEN 'INCONSISTENT' WHEN doc_id % 3 = 0 THEN 'SKIPPED' ELSE 'CONSISTENT' END AS said FROM documents JOIN labels USING (doc_id))"""
_COUNTS = """count(*) AS sample_count, count(*) FILTER (gold = 'INCONSISTENT' AND said = 'INCONSISTENT') AS tp, count(*) FILTER (gold = 'CONSISTENT' AND said = 'INCONSISTENT') AS fp, count(*) FILTER (gold = 'CONSISTENT' AND said <> 'INCONSISTENT') AS tn,
  count(*) FILTER (gold = 'INCONSISTENT' AND said <> 'INCONSISTENT') AS fn, count(*) FILTER (gold <> 'INSUFFICIENT') AS decidable, count(*) FILTER (gold <> 'INSUFFICIENT' AND said IN ('INCONSISTENT', 'CONSISTENT')) AS decided,
  count(*) FILTER (gold = 'INSUFFICIENT') AS insufficient, count(*) FILTER (gold = 'INSUFFICIENT' AND said = 'INCONSISTENT') AS improper_confirmation, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (said IN ('UNCERTAIN', 'SKIPPED')) AS abstained,
  count(*) FILTER (gold = 'CONSISTENT' AND said = 'CONSISTENT') AS explicit, count(*) FILTER (gold = 'CONSISTENT') AS consistent, count(*) FILTER (status = 'COMPLETED') AS completed"""
_RATIOS = ", ".join(f"round({a}::DOUBLE / nullif({b}, 0), 9) AS {n}" for n, a, b in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "(2 * tp)", "2 * tp + fp + fn"), ("false_positive_rate", "fp", "fp + tn"), ("decision_coverage", "decided", "decidable"), ("abstention_rate", "abstained", "sample_count"), ("improper_confirmation_rate", "improper_confirmation", "insufficient"), ("explicit_consistency_rate", "explicit", "consistent"), ("complete_run_rate", "completed", "sample_count")))
_KEPT = "sample_count, tp, fp, tn, fn, decidable, decided, insufficient, improper_confirmation, failed, abstained"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.overall(_predictions(spark, sf_dir)))


METRICS_OVERALL = f"WITH {_PREDICTIONS}, c AS (SELECT {_COUNTS} FROM p) SELECT {_KEPT}, {_RATIOS} FROM c"


def metrics_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.grouped(_predictions(spark, sf_dir), "drift_type", "group_id"))


METRICS_GROUPED = f"""
WITH {_PREDICTIONS}, c AS (SELECT 'all' AS level, NULL AS key, {_COUNTS} FROM p UNION ALL SELECT 'drift_type', lang, {_COUNTS} FROM p GROUP BY lang UNION ALL SELECT 'group_id', source, {_COUNTS} FROM p GROUP BY source)
SELECT level, key, {_KEPT}, {_RATIOS} FROM c"""


def metrics_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    n = F.col("sample_id").cast("long")
    spoilt = p.withColumn("gold", F.when(n % 21 == 0, "MAYBE").otherwise(F.col("gold"))).withColumn("prediction", F.when(n % 28 == 0, "CONSISTENT").otherwise(F.col("prediction"))).withColumn("sample_id", F.when(n % 25 == 0, "").otherwise(F.col("sample_id")))
    return metrics.violations(spoilt).distinct()


METRICS_VIOLATIONS = f"""
WITH {_PREDICTIONS}, q AS (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN '' ELSE doc_id::VARCHAR END AS sample_id FROM p)
SELECT sample_id, 'EMPTY_ID' AS violation FROM q WHERE sample_id = '' UNION SELECT sample_id, 'DUPLICATE_ID' FROM q GROUP BY sample_id HAVING count(*) > 1
UNION SELECT sample_id, 'UNKNOWN_GOLD' FROM q WHERE doc_id % 21 = 0 UNION SELECT sample_id, 'FAILED_BUT_DEFINITE' FROM q WHERE doc_id % 28 = 0"""


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 199 == 0, "test").otherwise("dev").alias("split"))
    return metrics.split_leakage(docs, "source", "split")


SPLIT_LEAKAGE = "SELECT source, count(DISTINCT doc_id % 199 = 0) AS splits FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 199 = 0) > 1"


def ownership_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("e"))
    return metrics.interval_overlaps(items, ["l_orderkey"], "id", "s", "e")


OWNERSHIP_OVERLAP = """
WITH i AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS id, l_shipdate::DATE AS s, l_shipdate::DATE + l_quantity::INT AS e FROM lineitem)
SELECT a.l_orderkey, a.id AS left_id, b.id AS right_id FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.id < b.id AND a.s <= b.e AND b.s <= a.e"""


def scope_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("start_line"), (F.col("value") + 3).alias("end_line"), F.when(F.col("event_type") == "error", "INCONSISTENT").otherwise("CONSISTENT").alias("decision"))
    ranges = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 150).alias("user_id"), (F.col("c_custkey") % 50).cast("double").alias("start"), (F.col("c_custkey") % 50 + 9).cast("double").alias("end"))
    return review.scoped_prediction(review.contained(e, ranges, ["user_id"]), "user_id", "decision")


SCOPE_CONTAINMENT = """
WITH c AS (SELECT user_id, event_type = 'error' AS bad FROM events e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 150 = user_id AND c_custkey % 50 <= value AND value + 3 <= c_custkey % 50 + 9))
SELECT user_id, CASE WHEN bool_and(bad) THEN 'INCONSISTENT' WHEN NOT bool_or(bad) THEN 'CONSISTENT' ELSE 'UNCERTAIN' END AS prediction FROM c GROUP BY user_id"""


def keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans import corpus

    rows = corpus.parts(spark, sf_dir)
    return review.keyword_pairs(rows.select("k", corpus.code_text().alias("code")), rows.select("k", corpus.doc_text().alias("doc")), "k", "code", "doc")


KEYWORD_BASELINE = "SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 'SKIPPED' WHEN p_partkey % 17 = 0 OR p_partkey % 7 = 0 THEN 'INCONSISTENT' ELSE 'CONSISTENT' END AS prediction FROM part"


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each part among the parts of its type and size class by price, as if that were an alignment."""
    p = read(spark, sf_dir, "part")
    ranked = p.withColumn("rank", F.row_number().over(W.partitionBy("p_type", "p_size").orderBy("p_retailprice", "p_partkey")))
    targets = p.select("p_partkey").join(ranked.where("p_partkey % 30 <> 0").groupBy("p_partkey").agg(F.min("rank").alias("min_rank")), "p_partkey", "left")
    out = metrics.recall_at(targets, [1, 3, 5, 10])
    return out.withColumn("recall", F.round("recall", 9))


RECALL_AT_K = """
WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_retailprice, p_partkey) AS rank FROM part), t AS (SELECT p_partkey, CASE WHEN p_partkey % 30 <> 0 THEN rank END AS r FROM r)
SELECT k::INT AS k, count(*) FILTER (r <= k) AS hits, count(*) AS targets, round(count(*) FILTER (r <= k)::DOUBLE / count(*), 9) AS recall FROM t, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k"""


def review_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "labels")
    b = a.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 11 != 0, F.col("toxic")).alias("toxic"))
    return review.differences(a.where("doc_id % 13 <> 0"), b, "doc_id", ["quality", "toxic"])


REVIEW_DIFF = """
WITH a AS (SELECT doc_id FROM labels WHERE doc_id % 13 <> 0), b AS (SELECT doc_id FROM labels WHERE doc_id % 7 <> 0)
SELECT doc_id, 'ONLY_IN_FIRST' AS issue FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'ONLY_IN_SECOND' FROM b ANTI JOIN a USING (doc_id)
UNION ALL SELECT doc_id, 'DIFFERS:quality' FROM a JOIN b USING (doc_id) WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'DIFFERS:toxic' FROM a JOIN b USING (doc_id) WHERE doc_id % 11 = 0"""


def review_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = read(spark, sf_dir, "labels").select("doc_id", F.when(n % 6 == 0, " ").otherwise("anna").alias("reviewer"), F.when(n % 4 == 0, "YES").otherwise("CONSISTENT").alias("label"), F.concat((n % 90).cast("string"), F.lit("-"), (n % 70 + 5).cast("string")).alias("lines"))
    return review.field_issues(rows, "doc_id", ["reviewer"], {"label": ("CONSISTENT", "INCONSISTENT", "INSUFFICIENT")}, {"lines": F.lit(60)})


REVIEW_FIELDS = """
SELECT doc_id, 'EMPTY:reviewer' AS issue FROM labels WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'LABEL:label' FROM labels WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'LINES:lines' FROM labels WHERE doc_id % 90 = 0 OR doc_id % 90 > doc_id % 70 + 5 OR doc_id % 70 + 5 > 60"""


def dev_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return review.shared_with(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "hash").select("doc_id", "hash")


DEV_OVERLAP = "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)"


def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("method", F.col("user_id") % 7)
    return metrics.compare_methods(e, "method", "event_type", ["click", "error", "purchase", "signup", "view"], "value")


METHOD_COMPARISON = """
SELECT user_id % 7 AS method, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
  count(*) FILTER (event_type = 'view') AS "view", round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS usage FROM events GROUP BY 1"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with a returned item is a finding, any other one an open judgment."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("title"), viewer.category(F.col("o_orderstatus") == "P", F.when(F.col("o_orderstatus") == "F", "VERIFIED"), F.when(F.col("o_custkey") % 3 == 0, "UNCERTAIN")).alias("category"))
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))).alias("title")).where("title IS NOT NULL").withColumn("category", F.lit("confirmed"))
    return viewer.records(items, orders)


def viewer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


_RECORDS = """r AS (
  SELECT l_orderkey AS claim_id, max(l_linestatus) AS title, 'confirmed' AS category, 'finding' AS kind FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
  UNION ALL SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'ignored' WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_custkey % 3 = 0 THEN 'uncertain' ELSE 'other' END, 'judgment' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"""
VIEWER_RECORDS = f"WITH {_RECORDS} SELECT * FROM r"


def viewer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = viewer.search(_records(spark, sf_dir).where("kind = 'judgment'"), "Urgent", "title", "category")
    return viewer.page(found, 2, (F.col("category") == "confirmed").desc(), F.col("claim_id").asc())


VIEWER_PAGE = f"WITH {_RECORDS} SELECT * FROM r WHERE kind = 'judgment' AND contains(lower(title || ' ' || category), 'urgent') ORDER BY category = 'confirmed' DESC, claim_id LIMIT 12 OFFSET 24"


def viewer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.last_by_key(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


VIEWER_LATEST = "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


def viewer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.upsert(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


VIEWER_UPSERT = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def viewer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.tree(_files(spark, sf_dir).select(F.concat_ws("/", "repo_id", "path").alias("path")))


VIEWER_TREE = f"""
WITH p AS (SELECT string_split(repo_id || '/' || path, '/') AS w FROM {_PATHS}), n AS (SELECT w, unnest(range(1, len(w) + 1)) AS depth FROM p)
SELECT array_to_string(w[1:depth], '/') AS node, depth::INT AS depth, count(*) AS files FROM n GROUP BY ALL"""


def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    run = lambda name, where: e.where(where).agg(F.struct(F.lit("r").alias("repo_id"), F.lit("h").alias("head_sha"), F.lit("rules").alias("mode"), F.lit("c").alias("config_hash"), F.collect_set("event_type").alias("enabled_types"), F.lit(name).alias("run_id")).alias(name), F.count(F.lit(1)).alias(f"{name}_events"))
    pairs = run("a", "event_id % 2 = 0").crossJoin(run("b", "event_id % 2 = 1")).crossJoin(run("c", "event_type <> 'view'"))
    return pairs.select(viewer.comparable("a", "b").alias("a_b"), viewer.comparable("a", "c").alias("a_c"), viewer.comparable("a", "a").alias("a_a"), (F.col("b_events") - F.col("a_events")).alias("grown"))


REPORT_COMPARE = "SELECT true AS a_b, false AS a_c, false AS a_a, count(*) FILTER (event_id % 2 = 1) - count(*) FILTER (event_id % 2 = 0) AS grown FROM events"


def notice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.where(F.col("text").rlike("(?i)licen[sc]e|copyright")).select("doc_id", "line", X.escape_html(F.col("text")).alias("text"))


NOTICE_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, line::INT AS line, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS text FROM l WHERE regexp_matches(text, '(?i)licen[sc]e|copyright')"""


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat((F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-"), (F.col("doc_id") % 30).cast("string"))).otherwise("")).alias("at"), F.concat(F.lit("key "), "source", F.lit(" rest")).alias("msg"))
    at = X.line_coordinate(F.col("at"))
    return d.select("doc_id", X.short_hash(F.col("h")).alias("short"), at["first"].alias("first"), at["last"].alias("last"), X.redact(F.col("msg"), "src1").alias("msg"), X.indent(F.concat(F.lit("a\n"), F.col("at"))).alias("block"))


TEXT_HELPERS = """
WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 40 AS a, CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 END AS b, source FROM documents), v AS (SELECT *, a >= 1 AND (b IS NULL OR (b >= 1 AND a <= b)) AS ok FROM d)
SELECT doc_id, left(h, 10) || '…' || right(h, 6) AS short, CASE WHEN ok THEN a::INT END AS first, CASE WHEN ok THEN coalesce(b, a)::INT END AS last, 'key ' || replace(source, 'src1', '[redacted]') || ' rest' AS msg, '    a' || chr(10) || '    ' || a || coalesce('-' || b, '') AS block FROM v"""


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -"), n, F.lit(",3 +"), (F.col("p_size") + 2).cast("string"), F.lit(",3 @@\n same\n-old\n+new\n+more\n same\n"))
    return viewer.diff_lines(read(spark, sf_dir, "part").select("p_partkey", diff.alias("diff")), ["p_partkey"])


DIFF_LINES = """
SELECT p_partkey, r::INT AS row, kind, (p_size + o)::INT AS old_line, (p_size + 2 + n)::INT AS new_line, CASE WHEN r = 2 THEN '@@ -' || p_size || ',3 +' || (p_size + 2) || ',3 @@' ELSE t END AS text
FROM part, (VALUES (0, 'file', NULL, NULL, '--- a/x'), (1, 'file', NULL, NULL, '+++ b/x'), (2, 'hunk', NULL, NULL, ''), (3, 'same', 0, 0, ' same'), (4, 'remove', 1, NULL, '-old'), (5, 'add', NULL, 1, '+new'), (6, 'add', NULL, 2, '+more'), (7, 'same', 2, 3, ' same')) v(r, kind, o, n, t)"""


def snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.left("lang", F.lit(1)).alias("c"))
    lines = viewer.snippet_lines(docs, ["doc_id"], "text", F.col("c"))
    return lines.select("doc_id", "line", "hit", F.length("content").alias("chars"))


SNIPPET_LINES = """
WITH l AS (SELECT doc_id, left(lang, 1) AS c, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE length(text) > 0),
f AS (SELECT *, min(CASE WHEN contains(x, c) THEN line END) OVER (PARTITION BY doc_id) AS first FROM l)
SELECT doc_id, line::INT AS line, coalesce(line = first, false) AS hit, length(x)::INT AS chars FROM f"""


def signature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id"), "o_orderstatus")
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), "l_partkey")
    return viewer.with_signature(orders, facts, ["entity_id"], "l_returnflag", "R", "place", "l_partkey")


SIGNATURE_LOOKUP = """
SELECT o_orderkey AS entity_id, o_orderstatus, (SELECT arg_min(l_partkey, row(l_linenumber, l_partkey, l_suppkey)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS signature FROM orders"""


def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.over_cap(read(spark, sf_dir, "documents"), "source", 4)


SOURCE_CAP = "SELECT source, count(*) AS samples FROM documents GROUP BY source HAVING count(*) > 4"


def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 10).cast("long").alias("tokens"))
    granted = metrics.reserve(calls, ["user_id"], "event_id", "tokens", 20, 5_000)
    return granted.groupBy("user_id").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused")).crossJoin(metrics.request_bound(calls, 2, 3))


REQUEST_BUDGET = """
WITH RECURSIVE c AS (SELECT user_id, event_id, trunc(value * 10)::BIGINT AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(user_id, n, k, used, ok) AS (
  SELECT user_id, n, CASE WHEN tokens <= 5000 THEN 1 ELSE 0 END, CASE WHEN tokens <= 5000 THEN tokens ELSE 0 END, tokens <= 5000 FROM c WHERE n = 1
  UNION ALL SELECT c.user_id, c.n, w.k + CASE WHEN w.k < 20 AND w.used + c.tokens <= 5000 THEN 1 ELSE 0 END, w.used + CASE WHEN w.k < 20 AND w.used + c.tokens <= 5000 THEN c.tokens ELSE 0 END, w.k < 20 AND w.used + c.tokens <= 5000 FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1)
SELECT user_id, count(*) FILTER (ok) AS granted, count(*) FILTER (NOT ok) AS refused, (SELECT count(*) * 6 FROM c) AS requests FROM w GROUP BY user_id"""


def metrics_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = metrics.grouped(_predictions(spark, sf_dir), "group_id").select(F.coalesce("key", F.lit("all")).alias("key"), "tp", "fp", "recall")
    saved = now.where("key <> 'src3'").withColumn("tp", F.when(F.col("key") == "src5", F.col("tp") + 1).otherwise(F.col("tp")))
    return metrics.recheck(saved, now, ["key"])


METRICS_RECHECK = f"""
WITH {_PREDICTIONS}, g AS (SELECT source, count(*) FILTER (gold = 'INCONSISTENT') > 0 AS has FROM p GROUP BY source)
SELECT 'src5' AS key, 'tp' AS metric FROM g WHERE source = 'src5' UNION ALL SELECT 'src3', m FROM g, (VALUES ('tp'), ('fp'), ('recall')) v(m) WHERE source = 'src3' AND (m <> 'recall' OR has)"""


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = read(spark, sf_dir, "orders").select(k, F.sha1(k.cast("string").cast("binary")).alias("head_sha"), F.when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("COMPLETED").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("patch_id"), F.when(k % 6 == 0, "COMPLETED").alias("rescan_status"))
    return viewer.history(runs, ["o_orderkey"])


RUN_HISTORY = """
SELECT o_orderkey, 1 AS step, 'snapshot' AS event, sha1(o_orderkey::VARCHAR) AS detail FROM orders UNION ALL SELECT o_orderkey, 2, 'scan', CASE WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'COMPLETED' END FROM orders
UNION ALL SELECT o_orderkey, 3, 'patch', 'p' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 4, 'rescan', 'COMPLETED' FROM orders WHERE o_orderkey % 6 = 0"""


def closure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("confirmed"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 60)).alias("uncertain"))
    runs = e.select("user_id", F.struct("confirmed", "uncertain", F.lit(0).cast("long").alias("unverified"), F.when(F.col("user_id") % 7 == 0, "PARTIAL").otherwise("COMPLETED").alias("status")).alias("after"))
    runs = runs.withColumn("after", F.col("after").withField("confirmed", F.when(F.col("user_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("after.confirmed"))).withField("uncertain", F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("after.uncertain"))))
    return runs.select("user_id", viewer.closed(F.col("user_id") % 5 != 0, "after").alias("closed"))


CLOSURE_CHECK = """
SELECT user_id, user_id % 5 <> 0 AND user_id % 7 <> 0 AND (user_id % 2 = 0 OR count(*) FILTER (event_type = 'error') = 0) AND (user_id % 3 = 0 OR count(*) FILTER (event_type = 'view' AND value > 60) = 0) AS closed FROM events GROUP BY user_id"""


_ALL: list = [stable_ids, snapshot_admit, snapshot_filter, snapshot_diff, snapshot_hash, line_offsets, heading_context, asof_binding, align_candidates, align_property_only, ignore_rules, run_status, report_counts, integrity_violations, metrics_overall, metrics_grouped, metrics_violations, split_leakage, ownership_overlap, scope_containment, keyword_baseline, recall_at_k, review_diff, review_fields, dev_overlap, method_comparison, viewer_records, viewer_page, viewer_latest, viewer_upsert, viewer_tree, report_compare, notice_lines, text_helpers, diff_lines, snippet_lines, signature_lookup, source_cap, request_budget, metrics_recheck, run_history, closure_check]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
