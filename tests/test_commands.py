"""Admission, incomplete runs, applying patches, benchmarks, report files and providers."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F
from helpers import files, states

from plumbline.__main__ import main
from plumbline.functions.tables import Stages
from plumbline.operators import judge, report, scopes
from plumbline.operators.apply import apply_patch, patch_id_of, target_of
from plumbline.plans import scan as plan
from plumbline.plans.scan import Config, scan
from plumbline.sources.files import SAMPLES
from plumbline.sources.git import SourceError, read_working_tree

CODE = "def connect(timeout=10):\n    pass\n"
DOC = states("30")


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture
def repository(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "net.py").write_text(CODE)
    (repo / "use.md").write_text(DOC)
    git(repo, "init", "-q")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "x")
    return repo


def last_line(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_files_that_are_not_read_make_a_run_partial(spark, tmp_path, repository, capsys):
    assert main(["scan", str(repository), "--out", str(tmp_path / "a")]) == 1
    (repository / "big.py").write_text("x = 1\n" * 200_000)
    os.symlink("net.py", repository / "link.py")
    (repository / "bad.md").write_bytes(b"\xff\xfe")
    (repository / "build").mkdir()
    (repository / "build" / "z.py").write_text("x = 1\n")
    git(repository, "add", ".")
    git(repository, "commit", "-qm", "y")
    capsys.readouterr()
    for extra in ([], ["--working-tree"]):
        out = tmp_path / f"b{len(extra)}"
        assert main(["scan", str(repository), "--out", str(out), "--require-complete", *extra]) == 3
        told = last_line(capsys)
        assert told["status"] == "PARTIAL" and told["confirmed"] == 1
        notes = {(r.path, r.code, r.affects_completeness) for r in spark.read.parquet(f"{out}/diagnostics").collect() if r.stage == "repository"}
        assert notes == {("big.py", "LIMIT_EXCEEDED", True), ("link.py", "SYMLINK_SKIPPED", True), ("bad.md", "UNREADABLE_TEXT", True), ("build/z.py", "EXCLUDED", False)}
    assert main(["scan", str(repository), "--out", str(tmp_path / "c")]) == 1
    assert main(["scan", str(repository), "--out", str(tmp_path / "d"), "--fail-on", "none"]) == 0
    (repository / "use.md").unlink()
    gone = [r for r in read_working_tree(spark, str(repository)).collect() if r.path == "use.md"]
    assert gone[0].content is None and gone[0].mode is None


def test_budget_and_patterns(spark):
    rows = [("r", "h", p, b"x = 1\n", "100644", 6) for p in ("a.py", "b.py", "c.py", "d/e.py", "../f.py", "g.txt")]
    offered = spark.createDataFrame(rows, "repo_id string, head_sha string, path string, content binary, mode string, size long")
    kept, notes = plan.admitted(offered, Config(max_total_bytes=12, exclude=["d/*"]))
    assert sorted(r.path for r in kept.collect()) == ["a.py", "b.py"]
    assert {(r.path, r.code) for r in notes.collect()} == {("c.py", "LIMIT_EXCEEDED"), ("d/e.py", "EXCLUDED"), ("../f.py", "UNSAFE_PATH")}
    assert scan(offered, Config(max_total_bytes=1)).status.collect() == [("r", "PARTIAL")]
    for bad in ({"fail_on": "x"}, {"max_file_bytes": 0}, {"method": "full"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_patch_is_applied_once_and_put_back_on_faults(tmp_path, repository, capsys, monkeypatch):
    assert main(["patch", str(repository), "--out", str(tmp_path / "p")]) == 0
    fixes = json.loads((tmp_path / "p" / "fixes.json").read_text())
    assert main(["apply", str(repository), str(tmp_path / "p" / "fixes.json")]) == 0
    assert last_line(capsys) == {"written": ["use.md"]} and (repository / "use.md").read_text() == states("10")
    assert main(["apply", str(repository), str(tmp_path / "p" / "fixes.json")]) == 2
    assert "STALE_PATCH" in capsys.readouterr().err
    (repository / "use.md").write_text(DOC)
    for change in ({"validation": "CONFLICT"}, {"patch_id": "0"}, {"base_hashes": {}}, {"edits": []}, {"finding_ids": fixes["finding_ids"] * 2}):
        with pytest.raises(SourceError, match="INVALID_PATCH"):
            apply_patch(str(repository), fixes | change)
    for path in ("../use.md", "/use.md", "net.py", ".git/x.md", "a:b.md", "no.md", "x\\y.md"):
        with pytest.raises(SourceError, match="UNSAFE_PATCH"):
            target_of(repository, path)
    os.symlink(repository / "use.md", repository / "link.md")
    with pytest.raises(SourceError, match="UNSAFE_PATCH"):
        target_of(repository, "link.md")
    import hashlib

    from plumbline.operators import apply

    (repository / "z.md").write_text("zz")
    sha = lambda p: hashlib.sha256((repository / p).read_bytes()).hexdigest()
    two = {"patch_id": patch_id_of(["f1", "f2"]), "finding_ids": ["f1", "f2"], "validation": "VALIDATED", "base_hashes": {p: sha(p) for p in ("use.md", "z.md")}, "edits": [{"path": p, "start_byte": 0, "end_byte": 1, "new_text": "Q"} for p in ("use.md", "z.md")]}
    real = apply.replace_file
    calls = []

    def failing(path, data):
        calls.append(path.name)
        if calls == ["use.md", "z.md"]:
            raise OSError("disk full")
        real(path, data)

    monkeypatch.setattr(apply, "replace_file", failing)
    with pytest.raises(OSError, match="disk full"):
        apply_patch(str(repository), two)
    assert (repository / "use.md").read_text() == DOC and (repository / "z.md").read_text() == "zz" and calls == ["use.md", "z.md", "use.md"]


def test_benchmark_writes_predictions_and_metrics(spark, tmp_path, repository, capsys):
    head = subprocess.run(["git", "-C", str(repository), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    base = {c: "x" for c in SAMPLES.names} | {"repo_path": str(repository), "head_sha": head, "document_path": "use.md", "code_path": "net.py", "drift_type": "DEFAULT_VALUE"}
    rows = [base | {"sample_id": "s1", "gold": "INCONSISTENT", "claim_line": 3}, base | {"sample_id": "s2", "gold": "INSUFFICIENT", "claim_line": 1}, base | {"sample_id": "s3", "gold": "CONSISTENT", "claim_line": 3, "code_path": "other.py"}]
    manifest = tmp_path / "samples.jsonl"
    manifest.write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert main(["benchmark", str(manifest), "--out", str(tmp_path / "o")]) == 0
    told = last_line(capsys)
    assert (told["tp"], told["fp"], told["scans"], told["sample_count"]) == (1, 0, 1, 3)
    found = {r["sample_id"]: r["prediction"] for r in map(json.loads, (tmp_path / "o" / "predictions.jsonl").read_text().splitlines())}
    assert found == {"s1": "INCONSISTENT", "s2": "SKIPPED", "s3": "SKIPPED"}
    assert main(["benchmark", str(manifest), "--out", str(tmp_path / "o")]) == 2


def test_report_file_round_trip_and_refusals(spark, tmp_path, repository):
    assert main(["scan", str(repository), "--out", str(tmp_path / "o")]) == 1
    raw = json.loads((tmp_path / "o" / "report.json").read_text())
    shapes = {n: spark.read.parquet(f"{tmp_path}/o/{n}").schema for n in report.SECTIONS}
    got = report.read_json(spark, str(tmp_path / "o" / "report.json"), shapes)
    for name in report.SECTIONS:
        assert sorted(map(str, got[name].collect())) == sorted(map(str, spark.read.parquet(f"{tmp_path}/o/{name}").collect())), name
    assert got["manifest"].first().status == "COMPLETED" and set(raw["manifest"]["stage_seconds"]) == {"repository", "scan"}
    old = raw | {"schema_version": "1.0", "facts": [{k: v for k, v in f.items() if k != "provenance"} for f in raw["facts"]]}
    bad = [raw | {"schema_version": "9"}, raw | {"more": 1}, {k: v for k, v in raw.items() if k != "facts"}, raw | {"claims": {}}, raw | {"facts": [{"odd": 1}]}, raw | {"facts": [{"seq": "many"}]}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(old))
    assert report.read_json(spark, str(path), shapes)["facts"].first().provenance == []
    for b in bad:
        path.write_text(json.dumps(b))
        with pytest.raises(SourceError, match="INVALID_REPORT"):
            report.read_json(spark, str(path), shapes)
    path.write_text("[" + " " * (11 << 20) + "]")
    with pytest.raises(SourceError, match="are allowed"):
        report.read_json(spark, str(path), shapes)


def test_methods_with_a_provider(spark):
    class Sure:
        def judge(self, claim, facts):
            return {"decision": "CONSISTENT", "reason_code": f"SAW_{len(facts)}", "fact_ids": [f["fact_id"] for f in facts[:1]]}

    table = files(spark, {"net.py": CODE + "def other(timeout=f()):\n    pass\n", "use.md": DOC, "b.md": states("3", "`other`")})
    said = {m: {(r.decision, r.reason_code) for r in scan(table, Config(method=m, provider=Sure)).judgments.collect()} for m in ("full", "llm", "no_static")}
    assert said["full"] == {("INCONSISTENT", "LITERAL_MISMATCH"), ("CONSISTENT", "SAW_1")}
    assert said["llm"] == {("CONSISTENT", "SAW_1")} and said["no_static"] == {("CONSISTENT", "SAW_0")}
    waits, left = [], [ConnectionError(), TimeoutError(), TimeoutError()]

    class Flaky:
        def judge(self, claim, facts):
            if left:
                raise left.pop()
            return "answer"

    assert judge.Retrying(Flaky(), 4, waits.append).judge({}, []) == "answer" and waits == [1, 2, 4]
    left += [TimeoutError()] * 2
    with pytest.raises(TimeoutError):
        judge.Retrying(Flaky(), 2, waits.append).judge({}, [])


def test_scopes_and_target_ranks(spark):
    table = files(spark, {"net.py": CODE, "use.md": DOC, "same.md": states("10")})
    r = scan(table, Config())
    sample = "sample_id string, repo_id string, entity_names array<string>, code_path string, document_path string, subject string, predicate string, drift_type string, document_ranges array<struct<start:int,end:int>>"
    rows = [(i, "repo", ["net.connect", "none"], code, doc, "connect", "timeout", "DEFAULT_VALUE", [(a, b)]) for i, code, doc, a, b in (("hit", "net.py", "use.md", 1, 3), ("same", "net.py", "same.md", 3, 3), ("out", "net.py", "use.md", 1, 2), ("other", "x.py", "use.md", 1, 9))]
    rows.append(("lost", "gone", ["net.connect"], "net.py", "use.md", "connect", "timeout", "DEFAULT_VALUE", [(1, 3)]))
    samples = spark.createDataFrame(rows, sample).withColumn("required_provenance", F.expr("array()").cast(r.facts.schema["provenance"].dataType))
    got = {x.sample_id: (x.prediction, x.status) for x in scopes.predictions(samples, r.entities, r.facts, r.claims, r.judgments, r.status).collect()}
    assert got == {"hit": ("INCONSISTENT", "COMPLETED"), "same": ("CONSISTENT", "COMPLETED"), "out": ("SKIPPED", "COMPLETED"), "other": ("UNCERTAIN", "COMPLETED"), "lost": ("UNCERTAIN", "FAILED")}
    gold = spark.createDataFrame([("g", "repo", "use.md", 3, [("net.py", "net.connect", "timeout", "DEFAULT_VALUE", 1), ("net.py", "net.connect", "retries", "DEFAULT_VALUE", 1)]), ("h", "repo", "use.md", 9, [("net.py", "net.connect", "timeout", "DEFAULT_VALUE", 1)])], "sample_id string, repo_id string, document_path string, claim_line int, targets array<struct<path:string,subject:string,property:string,fact_kind:string,start_line:int>>")
    assert sorted(map(tuple, scopes.target_ranks(gold, r.claims, r.candidates, r.facts).collect())) == [("g", 0, 1), ("g", 1, None), ("h", 0, None)]


def test_stage_times_add_up():
    times = Stages()
    for _ in range(2):
        with times("a"):
            pass
    assert set(times.seconds) == {"a"} and times.seconds["a"] >= 0
