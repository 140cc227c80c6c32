"""Command line: python -m plumbline scan|patch|apply|benchmark|schema|doctor …"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.functions.tables import Stages, written
from plumbline.operators import patch, report
from plumbline.operators.apply import apply_patch
from plumbline.plans import benchmark
from plumbline.plans.scan import Config, config_hash, propose_patches, scan
from plumbline.sources.files import load_config
from plumbline.sources.git import SourceError, read_repository, read_working_tree


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def doctor() -> list[dict]:
    """Local readiness: OK, WARN or ERROR for each thing that a scan needs."""

    def run(*command: str) -> str | None:
        try:
            done = subprocess.run(command, capture_output=True, text=True, timeout=20)
            return (done.stdout or done.stderr).strip().splitlines()[0] if done.returncode == 0 else None
        except (OSError, subprocess.TimeoutExpired, IndexError):
            return None

    import pyspark

    checks = [("python", sys.version.split()[0], sys.version_info >= (3, 10)), ("pyspark", pyspark.__version__, pyspark.__version__ >= "4"), ("java", run("java", "-version"), None), ("git", run("git", "--version"), None)]
    return [{"check": n, "found": v, "status": "OK" if (ok if ok is not None else v) else "ERROR"} for n, v, ok in checks]


def _files(spark: SparkSession, a: argparse.Namespace, config: Config):
    """Every .py and .md file that the source names; what isn't read becomes a diagnostic of the scan."""
    if a.working_tree:
        return read_working_tree(spark, a.repo, suffixes=".py,.md")
    return read_repository(spark, a.repo, a.head, suffixes=".py,.md", max_file_bytes=str(config.max_file_bytes))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "patch", "schema"):
        c = commands.add_parser(name)
        c.add_argument("repo")
        c.add_argument("--head", default="HEAD")
        c.add_argument("--working-tree", action="store_true")
        c.add_argument("--config")
        c.add_argument("--require-complete", action="store_true", help="exit with 3 if anything wasn't read")
        c.add_argument("--fail-on", choices=("none", "confirmed"))
        c.add_argument("--out", required=name != "schema")
    c = commands.add_parser("apply", help="make the edits of a fixes.json in a working tree")
    c.add_argument("repo")
    c.add_argument("fixes")
    c = commands.add_parser("benchmark", help="predictions and metrics of a manifest of samples")
    c.add_argument("manifest")
    c.add_argument("--method", choices=("rules", "no_alignment", "no_verifier"), default="rules")
    c.add_argument("--out", required=True)
    commands.add_parser("doctor")
    a = parser.parse_args(arguments)
    if a.command == "doctor":
        found = doctor()
        print("\n".join(f"{c['status']} {c['check']}: {c['found']}" for c in found))
        return int(any(c["status"] == "ERROR" for c in found))
    try:
        if a.command == "apply":
            print(json.dumps({"written": apply_patch(a.repo, json.loads(Path(a.fixes).read_text(encoding="utf-8")))}))
            return 0
        out = Path(a.out) if a.out else None
        if out and out.is_dir() and list(out.iterdir()):
            raise SourceError("OUTPUT_EXISTS", str(out))
        spark = _session()
        if a.command == "benchmark":
            print(json.dumps(benchmark.run(spark, a.manifest, a.out, a.method)))
            return 0
        config = load_config(a.config, datetime.now(timezone.utc).date())
        config = replace(config, require_complete=config.require_complete or a.require_complete, fail_on=a.fail_on or config.fail_on)
        times = Stages()
        with times("repository"):
            files = written(_files(spark, a, config), "files")
        with times("scan"):
            result = scan(files, config)
        if a.command == "schema":
            print(report.json_schema(result))
            return 0
        if a.command == "patch":
            with times("patch"):
                row = propose_patches(result, config).where("validation = 'VALIDATED'").first()
            if row is None:
                raise SourceError("NO_PATCH", "no patch was proven")
            edits = spark.createDataFrame([(row["repo_id"], *e) for e in row["edits"]], "repo_id string, path string, start_byte long, end_byte long, new_text string, finding_id string")
            diffs = patch.unified_diffs(result.files, patch.apply_edits(result.files, edits)).orderBy("path").collect()
            out.mkdir(parents=True, exist_ok=True)
            (out / "fixes.diff").write_text("".join(d["diff"] for d in diffs), encoding="utf-8")
            (out / "fixes.json").write_text(json.dumps(row.asDict(True), ensure_ascii=False, indent=2), encoding="utf-8")
            return 0
        report.write(result, a.out, ("parquet", "md"))
        row = report.summary(result, config.fail_on, config.require_complete).first()
        if row:
            whole = report.to_json(result, row["repo_id"], config_hash(config), times.seconds)
            (out / "report.json").write_text(json.dumps(whole, ensure_ascii=False), encoding="utf-8")
        print(json.dumps(row.asDict() if row else {"status": "COMPLETED", "exit_code": 0}))
        return int(row["exit_code"]) if row else 0
    except (SourceError, OSError) as e:
        told = report.failure(e)
        print(json.dumps(told), file=sys.stderr)
        if getattr(a, "out", None) and told["code"] != "OUTPUT_EXISTS":
            Path(a.out).mkdir(parents=True, exist_ok=True)
            (Path(a.out) / "failure.json").write_text(json.dumps(told), encoding="utf-8")
        return 2


if __name__ == "__main__":
    os.environ.setdefault("PYTHONPATH", os.getcwd())
    sys.exit(main())
