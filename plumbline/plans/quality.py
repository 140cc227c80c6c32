"""Queries of admission, folding, patches, integrity, scopes and report structure, with independent SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ids import base_hashes as hashes_of
from plumbline.functions.ids import text_hash
from plumbline.operators import align as A
from plumbline.operators import integrity, metrics, scopes, viewer
from plumbline.operators.extract import extract_claims, extract_code
from plumbline.plans import corpus, relational
from plumbline.plans.extraction import CAUSE, P
from plumbline.plans.relational import read
from plumbline.plans.scan import Config, admitted, propose_patches, scan


def scan_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the files that a scan doesn't read, by settings, safety, limits and the byte budget."""
    files = relational._files(spark, sf_dir).withColumn("head_sha", F.lit(corpus.HEAD))
    _, notes = admitted(files, Config(exclude=["de/*"], max_file_bytes=9_000, max_total_bytes=20_000))
    return notes.select("repo_id", "path", "code", "affects_completeness")


SCAN_ADMISSION = f"""
WITH RECURSIVE v AS (
  SELECT repo_id, path, size, CASE WHEN NOT regexp_matches(path, '[^/]+\\.(py|md)$') THEN 'UNSUPPORTED' WHEN path LIKE 'build/%' OR path LIKE 'de/%' THEN 'EXCLUDED' WHEN path LIKE '../%' OR contains(path, '\\') THEN 'UNSAFE_PATH'
    WHEN mode = '120000' THEN 'SYMLINK_SKIPPED' WHEN size > 9000 THEN 'LIMIT_EXCEEDED' WHEN contains(text, chr(0)) THEN 'UNREADABLE_TEXT' ELSE 'READ' END AS code FROM {relational._PATHS}),
f AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS n FROM v WHERE code = 'READ'),
w(repo_id, n, path, used, ok) AS (
  SELECT repo_id, n, path, CASE WHEN size <= 20000 THEN size ELSE 0 END, size <= 20000 FROM f WHERE n = 1
  UNION ALL SELECT f.repo_id, f.n, f.path, w.used + CASE WHEN w.used + f.size <= 20000 THEN f.size ELSE 0 END, w.used + f.size <= 20000 FROM w JOIN f ON f.repo_id = w.repo_id AND f.n = w.n + 1)
SELECT repo_id, path, code, code <> 'EXCLUDED' AS affects_completeness FROM v WHERE code NOT IN ('READ', 'UNSUPPORTED')
UNION ALL SELECT repo_id, path, 'LIMIT_EXCEEDED', true FROM w WHERE NOT ok"""

#: Code of part k by k % 8, and the canonical value of item's default (null where nothing is proven).
FOLDED = (
    ("N = 3\ndef item(size=N + {}):\n    pass\n", "'[\"int\",' || (3 + size) || ']'"),
    ("def most():\n    return {}\ndef item(size=most()):\n    pass\n", "'[\"int\",' || size || ']'"),
    ("N = {}\ndef item(size=N):\n    pass\nN = 0\n", "'[\"int\",' || size || ']'"),
    ("N = {}\nN = other()\ndef item(size=N):\n    pass\n", "NULL"),
    ("N = [{}]\nN[0] = 2\ndef item(size=N):\n    pass\n", "NULL"),
    ("def item(size=-{}):\n    pass\n", "'[\"int\",-' || size || ']'"),
    ("def item(size=('a' + 'b', {})):\n    pass\n", "'[\"tuple\",[[\"str\",\"ab\"],[\"int\",' || size || ']]]'"),
    ("for N in range({}):\n    pass\ndef item(size=N):\n    pass\n", "NULL"),
)


def extract_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults that must be folded, bound at definition time, taken from a function's return, or left unproven."""
    rows = corpus.parts(spark, sf_dir)
    text = F.lit(None).cast("string")
    for i, (code, _) in enumerate(FOLDED):
        head, tail = code.split("{}")
        text = F.when(F.col("k") % len(FOLDED) == i, F.concat(F.lit(head), F.col("size"), F.lit(tail))).otherwise(text)
    files = corpus._files(rows, F.concat(F.lit("pkg/f"), F.col("k").cast("string"), F.lit(".py")), text)
    facts = extract_code(files).facts.where("fact_kind = 'DEFAULT_VALUE' AND property = 'size'")
    return facts.select(corpus.part_key(F.col("span.path")).alias("k"), "subject", "value_state", F.col("typed_value.canonical").alias("canonical"))


_FOLDED = " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(FOLDED))
EXTRACT_FOLDING = f"""
SELECT k, 'pkg.f' || k || '.item' AS subject, CASE WHEN canonical IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS value_state, canonical FROM (SELECT k, CASE k % 8 {_FOLDED} END AS canonical FROM ({P}))"""


def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source hints of linked headings; lines in fences, code blocks and comments say nothing."""
    rows, k = corpus.parts(spark, sf_dir), F.col("k").cast("string")
    says = F.concat(F.lit("`size` defaults to `"), F.col("size"), F.lit("`.\n"))
    plain = F.concat(F.lit("## `item`\n\n"), says)
    linked = F.concat(F.lit("## [`item`](../pkg/p"), k, F.lit(".py)\n\n"), says)
    fenced = F.concat(F.lit("## `item`\n\n```text\n"), says, F.lit("```\n"))
    indented = F.concat(F.lit("## `item`\n\n    "), says)
    text = F.when(F.col("k") % 4 == 0, plain).when(F.col("k") % 4 == 1, linked).when(F.col("k") % 4 == 2, fenced).otherwise(indented)
    claims = extract_claims(corpus._files(rows, F.concat(F.lit("docs/h"), k, F.lit(".md")), text)).claims
    return claims.select(corpus.part_key(F.col("span.path")).alias("k"), "subject", "predicate", "source_hint")


CLAIM_SOURCES = f"SELECT k, 'item' AS subject, 'size' AS predicate, CASE WHEN k % 4 = 1 THEN 'pkg/p' || k || '.py' END AS source_hint FROM ({P}) WHERE k % 4 < 2"


def patch_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proven patch for each repository with conflicts: its edits, and the files that it was made for."""
    config = Config(exports=False)
    found = propose_patches(scan(corpus.default_files(spark, sf_dir), config), config)
    return found.select("repo_id", F.size("edits").alias("edits"), F.size("finding_ids").alias("findings"), F.size("base_hashes").alias("files"), "validation")


PATCH_PROPOSAL = f"SELECT 'repo' || k % 8 AS repo_id, count(*)::INT AS edits, count(*)::INT AS findings, count(*)::INT AS files, 'VALIDATED' AS validation FROM (SELECT k, {CAUSE} AS reason_code FROM ({P})) WHERE reason_code = 'LITERAL_MISMATCH' GROUP BY ALL"


def report_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that has lost the facts of every 31st part and the claims of every 37th, and has every 41st entity twice."""
    r = scan(corpus.default_files(spark, sf_dir), Config(exports=False))
    k = corpus.part_key(F.col("span.path"))
    facts, claims = r.facts.where(k % 31 != 0), r.claims.where(k % 37 != 0)
    entities = r.entities.unionByName(r.entities.where(k % 41 == 0))
    return integrity.report_violations(r.files, entities, facts, claims, r.judgments, r.findings).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


REPORT_INTEGRITY = f"""
WITH p AS (SELECT k, {CAUSE} AS reason_code FROM ({P})),
v AS (
  SELECT 'entity twice' AS "check", k FROM p WHERE k % 41 = 0 UNION ALL SELECT 'entity twice', k FROM p WHERE k % 41 = 0 AND k % 19 = 0
  UNION ALL SELECT 'judgment without claim', k FROM p WHERE k % 37 = 0 UNION ALL SELECT 'judgment without fact', k FROM p WHERE k % 31 = 0 AND reason_code LIKE 'LITERAL%'
  UNION ALL SELECT 'finding without claim', k FROM p WHERE k % 37 = 0 AND reason_code = 'LITERAL_MISMATCH' UNION ALL SELECT 'finding without fact', k FROM p WHERE k % 31 = 0 AND reason_code = 'LITERAL_MISMATCH')
SELECT "check", count(*) AS n FROM v GROUP BY 1"""


def entity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that samples of part k mean: of the function in their code file, by name, property and kind; every 9th names another file."""
    code = extract_code(corpus.default_files(spark, sf_dir), store=True)
    k = F.col("k").cast("string")
    none = F.expr("array()").cast(code.facts.schema["provenance"].dataType)
    samples = corpus.parts(spark, sf_dir).select(k.alias("sample_id"), F.concat(F.lit("repo"), (F.col("k") % corpus.REPOS).cast("string")).alias("repo_id"), F.array(F.concat(F.lit("pkg.p"), k, F.lit(".item")), F.lit("no.such")).alias("entity_names"), F.concat(F.when(F.col("k") % 9 == 0, "alt/p").otherwise("pkg/p"), k, F.lit(".py")).alias("code_path"), F.when(F.col("k") % 5 == 0, "brand").otherwise("size").alias("predicate"), F.lit("DEFAULT_VALUE").alias("drift_type"), none.alias("required_provenance"))
    found = scopes.scoped_facts(samples, code.entities, code.facts)
    return found.join(code.facts, "fact_id").select("sample_id", "subject", "property")


ENTITY_SCOPE = f"SELECT k::VARCHAR AS sample_id, 'pkg.p' || k || '.item' AS subject, CASE WHEN k % 5 = 0 THEN 'brand' ELSE 'size' END AS property FROM ({P}) WHERE k % 9 <> 0"


def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of alignment against targets: every 23rd sample names a line without a claim."""
    files = corpus.default_files(spark, sf_dir)
    claims, facts = extract_claims(files, store=True).claims, extract_code(files, store=True).facts
    k = F.col("k").cast("string")
    target = F.struct(F.concat(F.lit("pkg/p"), k, F.lit(".py")).alias("path"), F.concat(F.lit("pkg.p"), k, F.lit(".item")).alias("subject"), F.lit("size").alias("property"), F.lit("DEFAULT_VALUE").alias("fact_kind"), F.lit(1).alias("start_line"))
    gold = corpus.parts(spark, sf_dir).select(k.alias("sample_id"), F.concat(F.lit("repo"), (F.col("k") % corpus.REPOS).cast("string")).alias("repo_id"), F.concat(F.lit("docs/p"), k, F.lit(".md")).alias("document_path"), F.when(F.col("k") % 23 == 0, 9).otherwise(3).alias("claim_line"), F.array(target).alias("targets"))
    return metrics.recall_at(scopes.target_ranks(gold, claims, A.candidates(A.align(claims, facts)), facts), [2, 5]).withColumn("recall", F.round("recall", 9))


GOLD_RECALL = f"SELECT v.k::INT AS k, count(*) FILTER (p.k % 23 <> 0) AS hits, count(*) AS targets, round(count(*) FILTER (p.k % 23 <> 0)::DOUBLE / count(*), 9) AS recall FROM ({P}) p, (VALUES (2), (5)) v(k) GROUP BY v.k"


def finding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return viewer.positions(orders, ["o_custkey"], F.col("o_orderkey").desc()).select("o_orderkey", "position", "of")


FINDING_POSITIONS = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) || ' / ' || count(*) OVER (PARTITION BY o_custkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders"


def value_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("size"), F.col("k") % 5
    kind = F.element_at(F.array(*map(F.lit, ("int", "str", "bool", "NoneType", "list"))), (k + 1).cast("int"))
    body = F.when(k == 0, n).when(k == 1, F.concat(F.lit('"a'), n, F.lit('"'))).when(k == 2, F.when(F.col("k") % 2 == 0, "true").otherwise("false")).when(k == 3, "null").otherwise(F.concat(F.lit('[["int",'), n, F.lit("]]")))
    canonical = F.concat(F.lit('["'), kind, F.lit('",'), body, F.lit("]"))
    return corpus.parts(spark, sf_dir).select("k", viewer.display(kind, canonical).alias("shown"))


VALUE_DISPLAY = f"SELECT k, CASE k % 5 WHEN 0 THEN size::VARCHAR WHEN 1 THEN '\"a' || size || '\"' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END WHEN 3 THEN 'None' ELSE '[[\"int\",' || size || ']]' END AS shown FROM ({P})"


def newline_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents whose lines end in CR LF for every second one: the same as with LF."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text_hash(text).alias("hash"))


NEWLINE_HASH = "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM documents"


def base_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language of a source the map of its documents to their hashes, asked for its first one."""
    docs = read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("source", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    found = docs.groupBy("source", "lang").agg(hashes_of(F.col("path"), F.col("sha")).alias("m"), F.min("path").alias("path"))
    return found.select("source", "lang", "path", F.size("m").alias("files"), F.element_at("m", F.col("path")).alias("sha"))


BASE_HASHES = """
SELECT source, lang, min(lpad(doc_id::VARCHAR, 12, '0')) AS path, count(*)::INT AS files, arg_min(sha256(coalesce(text, '')), doc_id) AS sha FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL"""


def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.scan_count(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


SCAN_COUNT = "SELECT count(DISTINCT (l_partkey, l_suppkey)) AS scans FROM lineitem"


def suite_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite for each customer: its orders are samples, their priorities methods."""
    o = read(spark, sf_dir, "orders")
    plans = o.groupBy(F.col("o_custkey").alias("suite_id")).agg(F.transform(F.slice(F.array_sort(F.collect_list("o_orderpriority")), 1, 3), lambda x: F.substring(x, 1, 1)).alias("methods"), F.collect_list(F.when(F.col("o_orderstatus") == "P", "draft").otherwise("adjudicated")).alias("statuses"), F.bool_or(F.col("o_orderkey") % 97 == 0).alias("cached"), (F.count(F.lit(1)) * 3).alias("requests"), F.lit(30).alias("budget"))
    return metrics.suite_issues(plans)


SUITE_CHECKS = """
WITH s AS (SELECT o_custkey AS suite_id, list_transform(list_sort(list(o_orderpriority))[1:3], lambda x: x[1:1]) AS m, bool_or(o_orderstatus = 'P') AS draft, bool_or(o_orderkey % 97 = 0) AS cached, count(*) * 3 AS requests FROM orders GROUP BY 1)
SELECT suite_id, 'NOT_ADJUDICATED' AS issue FROM s WHERE draft UNION ALL SELECT suite_id, 'METHODS' FROM s WHERE len(list_distinct(m)) < len(m) UNION ALL SELECT suite_id, 'CACHED' FROM s WHERE cached UNION ALL SELECT suite_id, 'BUDGET' FROM s WHERE requests > 30"""


def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of a report: quantities as intervals, flags as labels, and orders with a repeated line number."""
    i = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_linenumber").alias("first"), F.col("l_quantity").cast("int").alias("last"), "l_returnflag", F.when(F.col("l_suppkey") % 50 == 0, " ").otherwise(F.col("l_linestatus")).alias("state"))
    return viewer.structure_issues(i, "id", ["state"], [("first", "last")], {"l_returnflag": ("A", "N")})


STRUCTURE_CHECK = """
WITH i AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_linenumber AS a, trunc(l_quantity)::INT AS b, l_returnflag AS f, l_suppkey % 50 = 0 OR trim(l_linestatus) = '' AS empty FROM lineitem)
SELECT id, 'EMPTY:state' AS issue FROM i WHERE empty UNION ALL SELECT id, 'INTERVAL:first' FROM i WHERE a > b UNION ALL SELECT id, 'LABEL:l_returnflag' FROM i WHERE f NOT IN ('A', 'N') UNION ALL SELECT id, 'REPEATED' FROM i GROUP BY id HAVING count(*) > 1"""


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of requests that failed: each user's errors are attempts, one after another."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return e.select("user_id", F.explode(F.sequence(F.lit(0), F.col("attempts").cast("int") - 1)).alias("attempt")).select("user_id", "attempt", metrics.wait_seconds(F.col("attempt")).alias("seconds"))


RETRY_WAITS = """
SELECT user_id, attempt::INT AS attempt, CASE WHEN attempt = 0 THEN 1 WHEN attempt = 1 THEN 2 ELSE 4 END AS seconds FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) - 1 AS attempt FROM events WHERE event_type = 'error')"""

_ALL: list = [scan_admission, extract_folding, claim_sources, patch_proposal, report_integrity, entity_scope, gold_recall, finding_positions, value_display, newline_hash, base_hashes, scan_count, suite_checks, structure_check, retry_waits]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
