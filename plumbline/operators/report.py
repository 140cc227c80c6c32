"""Reports: summary, Markdown text, tables on disk, failures, schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import escape_html, indent
from plumbline.operators import metrics
from plumbline.operators.ignore import status_text
from plumbline.operators.snapshot import files_hash
from plumbline.sources.git import SourceError

TABLES = tuple("candidates claims diagnostics entities facts findings judgments rejected".split())


def summary(report, fail_on: str = "confirmed", require_complete: bool = False) -> DataFrame:
    """repo_id, status, facts, claims, confirmed, ignored, uncertain, exit_code: one row for each repository."""
    count = lambda df, name, c=F.lit(True): df.groupBy("repo_id").agg(F.count_if(c).alias(name))
    open_ = report.judgments.where("decision = 'UNCERTAIN'").select("repo_id", "claim_id").union(report.rejected.select("repo_id", "claim_id"))
    out = report.status
    for part in (count(report.facts, "facts"), count(report.claims, "claims"), count(report.findings, "confirmed", ~F.col("ignored")), count(report.findings, "ignored", F.col("ignored")), open_.groupBy("repo_id").agg(F.count_distinct("claim_id").alias("uncertain"))):
        out = out.join(part, "repo_id", "left")
    out = out.na.fill(0)
    return out.withColumn("exit_code", metrics.exit_code(F.col("status"), F.col("confirmed"), fail_on, require_complete))


def _section(facts_subject: Column, facts_property: Column) -> Column:
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    e = F.col("evidence")
    return F.concat_ws(
        "\n",
        line("## ", F.col("finding_id"), "\n"),
        line("Kind: ", F.col("drift_type"), "; evidence: ", F.col("verification_status"), "; ", status_text(), "\n"),
        line("Document: ", escape_html(e["document"]["path"]), ":", e["document"]["start_line"].cast("string"), "\n"),
        line(indent(F.col("quote")), "\n"),
        line("Code: ", escape_html(e["code"]["path"]), ":", e["code"]["start_line"].cast("string"), "\n"),
        line(indent(F.concat(facts_subject, F.lit("."), facts_property, F.lit(" = "), F.col("expression"))), "\n"),
        line("Rule: ", e["rule_id"], "\n"),
        F.when(F.col("drift_type") == "SIGNATURE", "Signatures aren't patched: the example has to be mended by hand.\n"),
    )


def markdown(report) -> DataFrame:
    """repo_id, text: a readable report for each repository, findings in the order of document and place."""
    place = F.struct(F.col("evidence.document.path").alias("p"), F.col("evidence.document.start_byte").alias("b"), "finding_id")
    named = report.findings.withColumn("fact_id", F.get("fact_ids", F.lit(0))).join(report.facts.select("repo_id", "fact_id", F.col("subject").alias("fs"), F.col("property").alias("fp")), ["repo_id", "fact_id"])
    sections = named.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), _section(F.col("fs"), F.col("fp")).alias("t")))).alias("s")).select("repo_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("sections"))
    asked = report.judgments.where("decision = 'UNCERTAIN'").select("repo_id", "claim_id", F.col("reason_code").alias("why")).union(report.rejected.select("repo_id", "claim_id", F.concat(F.lit("rejected, "), F.col("reason"))))
    open_ = asked.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "claim_id", F.lit(": "), "why"))), "\n").alias("open"))
    notes = report.diagnostics.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "code", F.lit(": "), "message", F.lit(" ("), escape_html(F.col("path")), F.lit(")")))), "\n").alias("notes"))
    s = summary(report).join(sections, "repo_id", "left").join(open_, "repo_id", "left").join(notes, "repo_id", "left")
    n = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("# Consistency report: "), "repo_id", F.lit("\n\n- Status: "), "status", F.lit("\n- Facts: "), n("facts"), F.lit("; claims: "), n("claims"), F.lit("\n- Confirmed: "), n("confirmed"), F.lit("; ignored: "), n("ignored"), F.lit("; uncertain: "), n("uncertain"), F.lit("\n- What isn't extracted isn't thereby consistent.\n"))
    text = F.concat_ws("\n", head, "sections", F.when(F.col("open").isNotNull(), F.concat(F.lit("## To be checked\n\n"), "open", F.lit("\n"))), F.concat(F.lit("## Diagnostics\n\n"), F.coalesce("notes", F.lit("None.")), F.lit("\n")))
    return s.select("repo_id", text.alias("text"))


def holds_something(spark: SparkSession, folder: str) -> bool:
    """Whether a folder of any filesystem that Spark writes to exists and isn't empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(path) and len(system.listStatus(path)) > 0


#: Sections of a report file and the tables that they come from.
SECTIONS = {n: n for n in ("entities", "facts", "claims", "candidates", "judgments", "findings", "rejected")}
VERSIONS = ("1.0", "2.0")
MOST_IMPORTED = 10 << 20


def to_json(report, repo_id: str, config_hash: str = "", stage_seconds: dict[str, float] | None = None) -> dict:
    """The report of one repository as one document, for people and viewers: manifest, snapshot, and every section as a list."""
    rows = lambda df: [json.loads(r) for r in df.where(F.col("repo_id") == repo_id).toJSON().collect()]
    files = report.files.where(F.col("repo_id") == repo_id).select("repo_id", "head_sha", "path", F.sha2("content", 256).alias("blob_hash"))
    heads = [r[0] for r in report.repositories.where(F.col("repo_id") == repo_id).select("head_sha").collect()]
    status = report.status.where(F.col("repo_id") == repo_id).first()
    digest = files_hash(files).first()
    manifest = {"schema_version": "2.0", "run_id": f"{repo_id}-{config_hash[:12]}", "config_hash": config_hash, "mode": "rules", "status": status["status"] if status else "FAILED", "stage_seconds": stage_seconds or {}, "diagnostics": rows(report.diagnostics)}
    at = {"repo_id": repo_id, "head_sha": heads[0] if heads else None, "files_hash": digest["files_hash"] if digest else None, "files": [{"path": r["path"], "blob_hash": r["blob_hash"]} for r in files.orderBy("path").collect()]}
    return {"schema_version": "2.0", "manifest": manifest, "snapshot": at} | {n: rows(getattr(report, t)) for n, t in SECTIONS.items()}


def read_json(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The sections of a report file as tables, and manifest (one row): strict about size, version, keys and types.

    A report of version 1.0 has no provenance; its facts get an empty one. Anything else out of place raises SourceError INVALID_REPORT.
    """
    found = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if found["length"] > MOST_IMPORTED:
        raise SourceError("INVALID_REPORT", f"{found['length']} bytes, {MOST_IMPORTED} are allowed")
    try:
        raw = json.loads(bytes(found["content"]))
    except ValueError as e:
        raise SourceError("INVALID_REPORT", f"not JSON: {e}") from e
    if not isinstance(raw, dict) or raw.get("schema_version") not in VERSIONS:
        raise SourceError("INVALID_REPORT", "unknown schema_version")
    wrong = set(raw) ^ {"schema_version", "manifest", "snapshot", *SECTIONS}
    if wrong - ({"patches"} & set(raw)):
        raise SourceError("INVALID_REPORT", f"missing or unknown sections {sorted(wrong)}")
    out = {}
    for name in SECTIONS:
        schema, rows = schemas[name], raw[name]
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise SourceError("INVALID_REPORT", f"{name} isn't a list of objects")
        unknown = {k for r in rows for k in r} - set(schema.names)
        if unknown:
            raise SourceError("INVALID_REPORT", f"{name}: unknown keys {sorted(unknown)}")
        if name == "facts" and raw["schema_version"] == "1.0":
            rows = [{"provenance": []} | r for r in rows]
        lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
        table = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
        try:
            table.write.format("noop").mode("overwrite").save()
        except Exception as e:
            raise SourceError("INVALID_REPORT", f"{name}: a value of another type") from e
        out[name] = table
    m = raw["manifest"]
    out["manifest"] = spark.createDataFrame([(m.get("run_id"), m.get("status"), m.get("mode"), m.get("config_hash"))], "run_id string, status string, mode string, config_hash string")
    return out


def write(report, folder: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """Every table under its name, and the summary; a folder that holds something is never written over."""
    if holds_something(report.files.sparkSession, folder):
        raise SourceError("OUTPUT_EXISTS", folder)
    for name in TABLES:
        df = getattr(report, name)
        for f in (f for f in formats if f != "md"):
            df.write.mode("errorifexists").format("json" if f == "jsonl" else "parquet").save(f"{folder}/{name}" + (".jsonl" if f == "jsonl" else ""))
    summary(report).write.mode("errorifexists").json(f"{folder}/summary.json")
    if "md" in formats:
        markdown(report).write.mode("errorifexists").parquet(f"{folder}/markdown")


def failure(error: Exception) -> dict:
    """What is written instead of a report when a run fails."""
    return {"status": "FAILED", "exit_code": 2, "code": getattr(error, "code", "INTERNAL_ERROR"), "message": str(error)[:500]}


def json_schema(report) -> str:
    """The schemas of all tables as one JSON text."""
    return json.dumps({n: json.loads(getattr(report, n).schema.json()) for n in TABLES}, indent=2, sort_keys=True)
