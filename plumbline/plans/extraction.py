"""Queries that extract, align, judge, verify and patch the part corpus, with SQL that derives the answers from the part's key."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.literals import documented_literal
from plumbline.functions.tables import ship, written
from plumbline.operators import align as A
from plumbline.operators import ignore, judge, patch, verify
from plumbline.operators.exports import module_closure, with_exports
from plumbline.operators.extract import extract_claims, extract_code
from plumbline.plans import corpus
from plumbline.plans.scan import Config, rescan, scan

P = "SELECT p_partkey AS k, p_size AS size, p_brand AS brand FROM part"
S = "(CASE WHEN k % 17 = 0 THEN 'factory()' ELSE size::VARCHAR END)"
CAUSE = "CASE WHEN k % 11 = 0 THEN 'VERSION_UNRESOLVED' WHEN k % 13 = 0 THEN 'QUALIFIED_ASSERTION' WHEN k % 19 = 0 THEN 'AMBIGUOUS' WHEN k % 17 = 0 THEN 'UNKNOWN_VALUE' WHEN k % 7 = 0 THEN 'LITERAL_MISMATCH' ELSE 'LITERAL_EQUAL' END"
DECISION = "CASE reason_code WHEN 'LITERAL_EQUAL' THEN 'CONSISTENT' WHEN 'LITERAL_MISMATCH' THEN 'INCONSISTENT' ELSE 'UNCERTAIN' END"


def key(column: str = "span.path") -> F.Column:
    return corpus.part_key(F.col(column)).alias("k")


def extract_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract_code(corpus.default_files(spark, sf_dir)).facts.where("fact_kind = 'DEFAULT_VALUE'")
    return facts.select("subject", "property", "value_state", F.col("typed_value.canonical").alias("canonical"), "expression", F.col("span.start_byte").alias("start_byte"), F.col("span.end_byte").alias("end_byte"), "fact_id")


EXTRACT_DEFAULTS = f"""
WITH p AS ({P}), f AS (SELECT 'pkg' AS folder, * FROM p UNION ALL SELECT 'alt', * FROM p WHERE k % 19 = 0),
t AS (SELECT *, {S} AS s, folder || '.p' || k || '.item' AS subject, 'def item(size=' || {S} || ', brand=''' || brand || '''):' || chr(10) || '    pass' || chr(10) AS code FROM f),
e AS (SELECT *, sha256(code) AS hash, left(sha256('["entity", "' || folder || '/p' || k || '.py", "' || subject || '", "1"]'), 24) AS entity FROM t)
SELECT subject, 'size' AS property, CASE WHEN k % 17 = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END AS value_state, CASE WHEN k % 17 <> 0 THEN '["int",' || s || ']' END AS canonical, s AS expression,
  14::BIGINT AS start_byte, (14 + length(s))::BIGINT AS end_byte, left(sha256('["fact", "' || entity || '", "size", "' || hash || '"]'), 24) AS fact_id FROM e
UNION ALL
SELECT subject, 'brand', 'KNOWN', '["str","' || brand || '"]', '''' || brand || '''', 14 + length(s) + 8, 14 + length(s) + 8 + length(brand) + 2, left(sha256('["fact", "' || entity || '", "brand", "' || hash || '"]'), 24) FROM e"""


def extract_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract_code(corpus.default_files(spark, sf_dir)).facts.where("fact_kind = 'SIGNATURE'")
    return facts.select("subject", "value_state", "receiver", F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["kind"], p["value_state"])), ",").alias("parameters"), F.col("span.end_byte").alias("end_byte"))


EXTRACT_SIGNATURES = f"""
WITH p AS ({P}), f AS (SELECT 'pkg' AS folder, * FROM p UNION ALL SELECT 'alt', * FROM p WHERE k % 19 = 0)
SELECT folder || '.p' || k || '.item' AS subject, 'KNOWN' AS value_state, 'none' AS receiver,
  'size:POSITIONAL_OR_KEYWORD:' || CASE WHEN k % 17 = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END || ',brand:POSITIONAL_OR_KEYWORD:KNOWN' AS parameters, (14 + length({S}) + 8 + length(brand) + 2 + 11)::BIGINT AS end_byte FROM f"""


def extract_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract_code(corpus.config_files(spark, sf_dir)).facts
    return facts.select(key(), "subject", "property", "fact_kind", "value_state", F.col("typed_value.canonical").alias("canonical"), "expression")


EXTRACT_CONFIG = f"""
WITH p AS ({P})
SELECT k, 'conf.p' || k || '.CFG' AS subject, 'size' AS property, 'CONFIG' AS fact_kind, CASE WHEN k % 7 = 0 OR k % 17 = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END AS value_state,
  CASE WHEN k % 7 = 0 OR k % 17 = 0 THEN NULL WHEN k % 5 = 0 THEN '["int",1]' ELSE '["int",' || size || ']' END AS canonical, CASE WHEN k % 5 = 0 AND k % 7 <> 0 AND k % 17 <> 0 THEN '1' ELSE {S} END AS expression FROM p
UNION ALL
SELECT k, 'conf.p' || k || '.CFG', 'brand', 'CONFIG', CASE WHEN k % 7 = 0 OR (k % 5 = 0 AND k % 17 = 0) THEN 'UNKNOWN' ELSE 'KNOWN' END,
  CASE WHEN NOT (k % 7 = 0 OR (k % 5 = 0 AND k % 17 = 0)) THEN '["str","' || brand || '"]' END, '''' || brand || '''' FROM p"""


def extract_claims_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = extract_claims(corpus.default_files(spark, sf_dir)).claims
    return claims.select(key(), "subject", "predicate", "kind", F.col("value.canonical").alias("canonical"), F.array_join("qualifiers", ",").alias("qualifiers"), "version_scope", F.col("span.start_line").alias("line"), F.col("value_span.start_byte").alias("start_byte"), "quote", "claim_id")


OWNER = "CASE WHEN k % 19 = 0 THEN 'p' ELSE 'pkg.p' END || k || '.item'"
EXTRACT_CLAIMS_PROSE = f"""
WITH p AS ({P}),
t AS (SELECT *, {OWNER} AS subject, CASE WHEN k % 7 = 0 THEN size + 1 ELSE size END AS v, CASE WHEN k % 13 = 0 THEN ' usually defaults to ' ELSE ' defaults to ' END AS verb FROM p),
d AS (SELECT *, '## ' || CASE WHEN k % 11 = 0 THEN 'Legacy ' ELSE '' END || '`' || subject || '`' || chr(10) || chr(10) AS head, '`size`' || verb || '`' || v || '`.' AS quote FROM t)
SELECT k, subject, 'size' AS predicate, 'DEFAULT_ASSERTION' AS kind, '["int",' || v || ']' AS canonical, CASE WHEN k % 13 = 0 THEN 'conditional' ELSE '' END AS qualifiers,
  CASE WHEN k % 11 = 0 THEN 'unresolved' ELSE 'current' END AS version_scope, 3 AS line, (length(head) + 6 + length(verb) + 1)::BIGINT AS start_byte, quote,
  left(sha256('["claim", "docs/p' || k || '.md", "' || length(head) || '", "' || (length(head) + 6 + length(verb) + 1) || '", "' || sha256(head || quote || chr(10)) || '"]'), 24) AS claim_id FROM d"""


def extract_claims_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = extract_claims(corpus.table_files(spark, sf_dir)).claims
    return claims.select(key(), "subject", "predicate", F.col("value.canonical").alias("canonical"), F.col("span.start_line").alias("line"), "extraction_method")


EXTRACT_CLAIMS_TABLE = f"""
SELECT k, 'pkg.p' || k || '.item' AS subject, 'size' AS predicate, '["int",' || size || ']' AS canonical, 5 AS line, 'table/1' AS extraction_method FROM ({P})
UNION ALL SELECT k, 'pkg.p' || k || '.item', 'brand', '["str","' || brand || '"]', 6, 'table/1' FROM ({P})"""


def extract_claims_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = extract_claims(corpus.call_files(spark, sf_dir)).claims
    return claims.select(key(), "subject", "kind", "positional_count", F.array_join("keyword_names", ",").alias("keywords"), "unpacking", "bound_receiver")


EXTRACT_CLAIMS_CALLS = f"""
SELECT k, 'pkg.p' || k || '.item' AS subject, 'CALL_EXAMPLE' AS kind, [0, 1, 3, 1, 0, 0][k % 6 + 1]::INT AS positional_count, ['', 'brand', '', 'size', 'colour', ''][k % 6 + 1] AS keywords, k % 6 = 5 AS unpacking, false AS bound_receiver FROM ({P})"""


def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = extract_code(corpus.default_files(spark, sf_dir).unionByName(corpus.config_files(spark, sf_dir)))
    return code.entities.groupBy("kind", F.element_at(F.split("module", r"\."), 1).alias("package")).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("signature")).alias("parameters"))


EXTRACT_ENTITIES = f"""
SELECT 'function' AS kind, 'pkg' AS package, count(*) AS entities, 2 * count(*) AS parameters FROM ({P}) UNION ALL
SELECT 'function', 'alt', count(*), 2 * count(*) FROM ({P}) WHERE k % 19 = 0 UNION ALL
SELECT 'config', 'conf', count(*), 0 FROM ({P})"""


def export_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = extract_code(corpus.export_files(spark, sf_dir))
    facts = with_exports(code.facts, code.imports).where("fact_kind = 'DEFAULT_VALUE'")
    return facts.select("subject", "property", F.col("typed_value.canonical").alias("canonical"), F.col("span.path").alias("path"), F.size("provenance").alias("hops"))


EXPORT_CLOSURE = """
WITH s AS (
  SELECT 'geo.r' || r_regionkey || '.f' AS subject, r_regionkey AS r, 0 AS hops FROM region
  UNION ALL SELECT 'geo.n' || n_nationkey || '.f', n_regionkey, 1 FROM nation
  UNION ALL SELECT 'sup.s' || s_suppkey || '.g', n_regionkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT subject, 'x' AS property, '["int",' || r || ']' AS canonical, 'geo/r' || r || '.py' AS path, hops FROM s"""


def module_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = read("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    s = read("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    back = read("region").select(F.concat(F.lit("r"), "r_regionkey").alias("a"), F.concat(F.lit("n"), "r_regionkey").alias("b"))
    return module_closure(n.unionByName(s).unionByName(back), "a", "b")


MODULE_REACH = """
WITH RECURSIVE e(a, b) AS (
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region),
w(source, target, hops, seen) AS (
  SELECT a, b, 1, [a, b] FROM e UNION ALL SELECT w.source, e.b, w.hops + 1, list_append(w.seen, e.b) FROM w JOIN e ON e.a = w.target WHERE NOT list_contains(w.seen, e.b))
SELECT source, target, min(hops) AS hops FROM w GROUP BY ALL"""


def _extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and facts of files, each written once."""
    return written(extract_claims(files).claims, "claims"), written(extract_code(files).facts, "facts")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align(*_extracted(corpus.default_files(spark, sf_dir)))


def align_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select(key(), "rank", "matches", "reason", F.col("fact.subject").alias("fact_subject")).withColumn("fact_subject", F.when(F.col("matches") == 1, F.col("fact_subject")))


ALIGN_CORPUS = f"""
SELECT k, r AS rank, CASE WHEN k % 19 = 0 THEN 2 ELSE 1 END::BIGINT AS matches, CASE WHEN k % 19 = 0 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS reason, CASE WHEN k % 19 <> 0 THEN 'pkg.p' || k || '.item' END AS fact_subject
FROM ({P}), (VALUES (1), (2)) v(r) WHERE r = 1 OR k % 19 = 0"""


def judge_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge(_aligned(spark, sf_dir)).select(key(), "decision", "reason_code", F.size("fact_ids").alias("cited"))


JUDGE_LITERALS = f"SELECT k, {DECISION} AS decision, reason_code, CASE WHEN reason_code LIKE 'LITERAL%' THEN 1 ELSE 0 END AS cited FROM (SELECT k, {CAUSE} AS reason_code FROM ({P}))"


def judge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.call_files(spark, sf_dir)
    judged = judge.judge(A.align(*_extracted(files)))
    return judged.select(key(), "decision", "reason_code")


_REASONS = ", ".join(f"'{r}'" for _, r in corpus.CALLS.values())
JUDGE_CALLS = f"""
SELECT k, CASE reason_code WHEN 'CALL_ACCEPTED' THEN 'CONSISTENT' WHEN 'CALL_BINDING_ERROR' THEN 'INCONSISTENT' ELSE 'UNCERTAIN' END AS decision, reason_code FROM (SELECT k, [{_REASONS}][k % 6 + 1] AS reason_code FROM ({P}))"""


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of which some are forged: claims of every 23rd part quote something else, of every 29th say another value."""
    files = corpus.default_files(spark, sf_dir)
    k = corpus.part_key(F.col("span.path"))
    judged = judge.judge(_aligned(spark, sf_dir))
    forged = judged.withColumn("quote", F.when(k % 23 == 0, F.concat("quote", F.lit(" "))).otherwise(F.col("quote"))).withColumn("subject", F.when((k % 29 == 0) & (k % 23 != 0), "forged").otherwise(F.col("subject")))
    checked = verify.verify(forged, files, *_extracted(files))
    return checked.select(key(), F.coalesce("reject", F.lit("PROVEN")).alias("outcome"))


VERIFY_FINDINGS = f"""
SELECT k, CASE WHEN k % 23 = 0 THEN 'EVIDENCE_MISMATCH' WHEN k % 29 = 0 THEN 'REEXTRACTION_MISMATCH' ELSE 'PROVEN' END AS outcome FROM (SELECT k, {CAUSE} AS reason_code FROM ({P})) WHERE reason_code = 'LITERAL_MISMATCH'"""


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scan(corpus.default_files(spark, sf_dir), Config(exports=False))
    found = report.findings.select("repo_id", "claim_id", F.lit(True).alias("f"))
    return report.judgments.join(found, ["repo_id", "claim_id"], "left").select(key(), "decision", "reason_code", F.col("f").isNotNull().alias("published"))


RUN_FINDINGS = f"SELECT k, {DECISION} AS decision, reason_code, reason_code = 'LITERAL_MISMATCH' AS published FROM (SELECT k, {CAUSE} AS reason_code FROM ({P}))"


def no_alignment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation without ownership: every claim meets the first size fact of its repository."""
    report = scan(corpus.default_files(spark, sf_dir), Config(exports=False, method="no_alignment", top_k=1))
    return report.judgments.groupBy("repo_id").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct(F.col("fact.fact_id")).alias("facts_used"), F.count_if(F.col("decision") == "UNCERTAIN").alias("uncertain"))


NO_ALIGNMENT_RUN = f"""
WITH p AS (SELECT *, 'repo' || k % 8 AS repo_id FROM ({P})),
f AS (SELECT repo_id, path, k FROM (SELECT repo_id, 'pkg/p' || k || '.py' AS path, k FROM p UNION ALL SELECT repo_id, 'alt/p' || k || '.py', k FROM p WHERE k % 19 = 0)),
u AS (SELECT repo_id, arg_min(k, path) % 17 = 0 AS unknown FROM f GROUP BY repo_id)
SELECT repo_id, count(*) AS claims, 1::BIGINT AS facts_used, count(*) FILTER (unknown OR k % 11 = 0 OR k % 13 = 0) AS uncertain FROM p JOIN u USING (repo_id) GROUP BY repo_id"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus.default_files(spark, sf_dir), Config(exports=False)).findings


def ignore_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [ignore.Rule("old", "docs/p1*.md", expires=date(2023, 12, 31)), ignore.Rule("known", "docs/p?4*.md", expires=date(2024, 1, 1)), ignore.Rule("all of one", "**/p2*.md", rule_id="DEFAULT_VALUE/1")]
    found = scan(corpus.default_files(spark, sf_dir), Config(exports=False, ignores=rules, scan_date=date(2024, 1, 1))).findings
    return found.select(key("evidence.document.path"), "ignored", "ignore_reason", F.col("ignore_expires").cast("string").alias("ignore_expires"), ignore.status_text().alias("status"))


_M = f"SELECT k, 'docs/p' || k || '.md' AS path FROM (SELECT k, {CAUSE} AS reason_code FROM ({P})) WHERE reason_code = 'LITERAL_MISMATCH'"
IGNORE_FINDINGS = f"""
WITH m AS ({_M}), r AS (SELECT k, path LIKE 'docs/p1%.md' AS gone, path LIKE 'docs/p_4%.md' AS known, path LIKE '%/p2%.md' AS one FROM m),
s AS (SELECT k, known OR one AS ignored, CASE WHEN known THEN 'known' WHEN one THEN 'all of one' WHEN gone THEN 'old' END AS ignore_reason, CASE WHEN known THEN '2024-01-01' WHEN one THEN NULL WHEN gone THEN '2023-12-31' END AS ignore_expires FROM r)
SELECT *, CASE WHEN ignored AND ignore_expires IS NULL THEN 'ignored without a deadline; reason: ' || ignore_reason WHEN ignored THEN 'ignored until ' || ignore_expires || '; reason: ' || ignore_reason
  WHEN ignore_expires IS NOT NULL THEN 'not ignored, the rule expired on ' || ignore_expires || '; reason: ' || ignore_reason ELSE 'not ignored' END AS status FROM s"""


def patch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = patch.shifted(patch.overlaps(patch.edits_of(_findings(spark, sf_dir))))
    return edits.select(key("path"), "start_byte", "end_byte", "new_text", "overlap", "new_start")


_HEAD = f"length('## ' || '`' || {OWNER} || '`') + 2"
PATCH_EDITS = f"""
SELECT k, ({_HEAD} + 6 + 13 + 1)::BIGINT AS start_byte, ({_HEAD} + 6 + 13 + 1 + length((size + 1)::VARCHAR))::BIGINT AS end_byte, size::VARCHAR AS new_text, false AS overlap, ({_HEAD} + 6 + 13 + 1)::BIGINT AS new_start
FROM (SELECT *, {CAUSE} AS reason_code FROM ({P})) WHERE reason_code = 'LITERAL_MISMATCH'"""


def patch_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of comments in line items: one for each item of an order, in the order of their numbers."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edits = items.select(F.col("l_orderkey").cast("string").alias("repo_id"), F.lit("f.md").alias("path"), (F.col("l_linenumber") * 100 + F.col("l_partkey") % 90).cast("long").alias("start_byte"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("finding_id"), F.substring(F.lit("x" * 60), F.lit(1), F.col("l_quantity").cast("int")).alias("new_text"))
    edits = edits.withColumn("end_byte", F.col("start_byte") + 20).distinct()
    return patch.shifted(patch.overlaps(edits)).select("repo_id", "finding_id", "start_byte", "end_byte", "overlap", "new_start")


PATCH_SHIFT = """
WITH e AS (SELECT DISTINCT l_orderkey::VARCHAR AS repo_id, (l_linenumber * 100 + l_partkey % 90)::BIGINT AS start_byte, l_partkey || '-' || l_suppkey || '-' || l_quantity || '-' || l_extendedprice AS finding_id, l_quantity::INT AS n FROM lineitem)
SELECT repo_id, finding_id, start_byte, start_byte + 20 AS end_byte, coalesce(lead(start_byte) OVER w < start_byte + 20, false) AS overlap,
  (start_byte + coalesce(sum(n - 20) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS new_start FROM e WINDOW w AS (PARTITION BY repo_id ORDER BY start_byte, start_byte + 20, finding_id)"""


def patch_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan says of the documents once all edits are made: nothing is left, and no other decision changes."""
    files = corpus.default_files(spark, sf_dir)
    first = scan(files, Config(exports=False))
    again = rescan(first, patch.apply_edits(files, patch.edits_of(first.findings)), Config(exports=False))
    return again.judgments.groupBy("decision", "reason_code").agg(F.count(F.lit(1)).alias("claims"))


PATCH_RESCAN = f"""
SELECT {DECISION} AS decision, reason_code, count(*) AS claims FROM (SELECT k, replace({CAUSE}, 'MISMATCH', 'EQUAL') AS reason_code FROM ({P})) GROUP BY ALL"""


def patch_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.default_files(spark, sf_dir)
    edits = patch.edits_of(scan(files, Config(exports=False)).findings)
    edited = files.join(edits.select(patch.FILE).distinct(), patch.FILE, "left_semi")
    return patch.unified_diffs(edited, patch.apply_edits(edited, edits)).select(key("path"), "diff")


_LINE = "'`size` defaults to `' || {} || '`.' || chr(10)"
PATCH_DIFFS = f"""
SELECT k, '--- a/docs/p' || k || '.md' || chr(10) || '+++ b/docs/p' || k || '.md' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' ## `' || {OWNER} || '`' || chr(10) || ' ' || chr(10) || '-' || {_LINE.format("(size + 1)")} || '+' || {_LINE.format("size")} AS diff
FROM (SELECT *, {CAUSE} AS reason_code FROM ({P})) WHERE reason_code = 'LITERAL_MISMATCH'"""


def _typed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([documented_literal(x) or {"type": None, "canonical": None} for x in raw], columns=["type", "canonical"])


def literal_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed spellings of values as documents write them: numbers, strings, lists, bare words and expressions."""
    ship(spark)
    typed = F.pandas_udf(_typed, "type string, canonical string")
    k, n = F.col("k") % 6, F.col("size")
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit("["), n, F.lit(", True]"))).when(k == 2, F.concat(F.lit("utf-"), n)).when(k == 3, F.concat(F.lit("f("), n, F.lit(")"))).when(k == 4, F.concat(F.lit("{'b': "), n, F.lit(", 'a': None}"))).otherwise(F.concat(F.lit("-"), n, F.lit(".5")))
    return corpus.parts(spark, sf_dir).select("k", typed(raw).alias("t")).select("k", F.col("t.type").alias("type"), F.col("t.canonical").alias("canonical"))


LITERAL_CANONICAL = f"""
SELECT k, ['int', 'list', 'str', NULL, 'dict', 'float'][k % 6 + 1] AS type, CASE k % 6 WHEN 0 THEN '["int",' || size || ']' WHEN 1 THEN '["list",[["int",' || size || '],["bool",true]]]' WHEN 2 THEN '["str","utf-' || size || '"]'
  WHEN 4 THEN '["dict",[[["str","a"],["NoneType",null]],[["str","b"],["int",' || size || ']]]]' WHEN 5 THEN '["float",-' || size || '.5]' END AS canonical FROM ({P})"""

QUERIES = {f.__name__: f for f in (extract_defaults, extract_signatures, extract_config, extract_claims_prose, extract_claims_table, extract_claims_calls, extract_entities, export_closure, module_reach, align_corpus, judge_literals, judge_calls, verify_findings, run_findings, no_alignment_run, ignore_findings, patch_edits, patch_shift, patch_rescan, patch_diffs, literal_canonical)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
