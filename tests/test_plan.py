"""Verification, suppression, patches, reports, integrity, sources and streaming, end to end."""

import subprocess
from datetime import date

import pytest
from helpers import example, files, states
from pyspark.sql import functions as F

from plumbline.operators import integrity, metrics, patch, report, snapshot, viewer
from plumbline.operators.ignore import Rule, apply_rules
from plumbline.plans.scan import Config, propose_patches, scan
from plumbline.sources import files as source_files
from plumbline.sources import git

C60 = "def connect(timeout=60): return timeout\n"


def test_patch_mends_prose_and_leaves_examples(spark):
    doc = states("30") + "\ntimeout defaults to 31; timeout defaults to `3000`.\n\n```python\nconnect(timeout=30)\n```\n"
    repo = files(spark, {"client.py": C60, "d.md": doc})
    first = scan(repo)
    assert first.findings.count() == 3
    patches = propose_patches(first).collect()
    assert [(p.validation, len(p.edits)) for p in patches] == [("VALIDATED", 3)]
    edits = patch.edits_of(first.findings)
    patched = patch.apply_edits(repo, edits)
    text = bytes(patched.where("path = 'd.md'").first().content).decode()
    assert text == doc.replace("`30`", "`60`").replace("to 31;", "to 60;").replace("`3000`", "`60`")
    again = scan(patched)
    assert again.findings.count() == 0 and again.judgments.where("decision = 'CONSISTENT'").count() == 4
    diff = patch.unified_diffs(repo, patched).first().diff
    assert diff.startswith("--- a/d.md\n+++ b/d.md\n@@") and diff.count("\n-") == 2
    assert patch.stale_files(edits.select("repo_id", "path", "blob_hash"), patched).count() == 1
    assert patch.stale_files(edits.select("repo_id", "path", "blob_hash"), repo).count() == 0


def test_no_patch_for_what_it_cannot_prove(spark):
    gone = files(spark, {"client.py": "def connect(timeout='a`b'): pass\n", "d.md": states("30")})
    assert propose_patches(scan(gone)).collect() == []
    call = files(spark, {"client.py": "def connect(host): pass\n", "d.md": example("connect()")})
    found = scan(call)
    assert found.findings.first().drift_type == "SIGNATURE" and propose_patches(found).collect() == []


def test_overlaps_and_missing_line_feed(spark):
    edits = spark.createDataFrame([("r", "a", "d.md", 0, 5, "x"), ("r", "b", "d.md", 4, 6, "y"), ("r", "c", "d.md", 6, 7, "zz")], "repo_id string, finding_id string, path string, start_byte long, end_byte long, new_text string")
    assert [r.overlap for r in patch.overlaps(edits).orderBy("start_byte").collect()] == [True, False, False]
    before, after = files(spark, {"d.md": "a\nb"}), files(spark, {"d.md": "a\nc"})
    assert patch.unified_diffs(before, after).first().diff.count("\\ No newline at end of file\n") == 2


def test_forged_judgments_are_rejected(spark):
    from plumbline.operators.align import align
    from plumbline.operators.extract import extract_claims, extract_code
    from plumbline.operators.judge import judge
    from plumbline.operators.verify import verify

    repo = files(spark, {"client.py": C60, "d.md": states("30")})
    claims, facts = extract_claims(repo).claims, extract_code(repo).facts
    judged = judge(align(claims, facts))
    link = F.array(F.struct(F.lit("no.py").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(0).cast("long").alias("start_byte"), F.lit(1).cast("long").alias("end_byte"), F.lit("h").alias("blob_hash")))
    cases = {
        None: judged,
        "INVALID_REFERENCE": judged.withColumn("fact_ids", F.array(F.lit("none"))),
        "EVIDENCE_MISMATCH": judged.withColumn("span", F.col("span").withField("start_line", F.lit(9))),
        "REEXTRACTION_MISMATCH": judged.withColumn("value", F.col("value").withField("canonical", F.lit('["int",31]'))),
    }
    for want, forged in cases.items():
        assert [r.reject for r in verify(forged, repo, claims, facts).collect()] == [want]
    hashes = judged.withColumn("fact", F.col("fact").withField("provenance", link))
    assert verify(hashes, repo, claims, facts).first().reject == "EVIDENCE_MISMATCH"
    equal = files(spark, {"client.py": C60, "d.md": states("60")})
    lie = judge(align(extract_claims(equal).claims, extract_code(equal).facts)).withColumn("decision", F.lit("INCONSISTENT"))
    assert verify(lie, equal, extract_claims(equal).claims, extract_code(equal).facts).first().reject == "CONFLICT_NOT_PROVEN"


def test_expiry_of_rules(spark):
    day = date(2024, 5, 1)
    one = spark.createDataFrame([("f", "docs/a.md", "DEFAULT_VALUE/1")], "finding_id string, p string, r string")
    cases = [([Rule("x", "other/*.md")], (False, None, None)), ([Rule("x")], (True, "x", None)), ([Rule("x", expires=date(2024, 6, 1))], (True, "x", date(2024, 6, 1))), ([Rule("x", expires=day)], (True, "x", day)), ([Rule("x", expires=date(2024, 4, 30))], (False, "x", date(2024, 4, 30))), ([Rule("old", expires=date(2024, 4, 30)), Rule("new")], (True, "new", None)), ([], (False, None, None))]
    for rules, want in cases:
        r = apply_rules(one, rules, day, F.col("p"), F.col("r")).first()
        assert (r.ignored, r.ignore_reason, r.ignore_expires) == want


def test_identities_survive_unrelated_changes(spark):
    a = scan(files(spark, {"client.py": C60, "d.md": states("30")}))
    b = scan(files(spark, {"client.py": C60, "d.md": states("30"), "z.py": "X = 1\n"}, sha="b" * 40))
    ids = lambda rep, t, c: {r[0] for r in getattr(rep, t).select(c).collect()}
    assert ids(a, "facts", "fact_id") < ids(b, "facts", "fact_id") and ids(a, "claims", "claim_id") == ids(b, "claims", "claim_id")
    assert ids(a, "findings", "finding_id").isdisjoint(ids(b, "findings", "finding_id"))


def test_integrity(spark):
    repo = files(spark, {"client.py": C60, "d.md": states("30")})
    r = scan(repo)
    check = lambda **c: {v.check for v in integrity.report_violations(*[c.get(n, getattr(r, n)) for n in ("files", "entities", "facts", "claims", "judgments", "findings")]).collect()}
    assert check() == set()
    assert check(files=repo.unionByName(repo)) >= {"file twice"} and check(facts=r.facts.unionByName(r.facts)) >= {"fact twice"}
    assert check(entities=r.entities.limit(0)) == {"fact without entity"} and "stale claim" in check(files=files(spark, {"client.py": C60, "d.md": "x"}))
    assert check(claims=r.claims.limit(0)) >= {"judgment without claim", "finding without claim"} and check(facts=r.facts.limit(0)) >= {"judgment without fact", "finding without fact"}
    moved = r.findings.withColumn("evidence", F.col("evidence").withField("document", F.col("evidence.document").withField("start_byte", F.lit(1).cast("long"))))
    assert check(findings=moved) == {"finding with other evidence"}


def test_status_summary_and_markdown(spark, tmp_path):
    repo = files(spark, {"client.py": C60, "b.py": "def (", "d<1>.md": states("30"), "e.md": states("30", "旧版 `connect`")})
    r = scan(repo)
    s = report.summary(r).first()
    assert (s.status, s.confirmed, s.ignored, s.uncertain, s.exit_code) == ("PARTIAL", 1, 0, 1, 1)
    text = report.markdown(r).first().text
    assert "d&lt;1&gt;.md:3" in text and "VERSION_UNRESOLVED" in text and "PYTHON_PARSE_ERROR" in text and "client.connect.timeout = 60" in text
    report.write(r, str(tmp_path / "out"), ("parquet", "jsonl", "md"))
    assert source_files.read_report_table(spark, str(tmp_path / "out"), "findings").count() == 1
    with pytest.raises(git.SourceError, match="OUTPUT_EXISTS"):
        report.write(r, str(tmp_path / "out"))
    assert '"findings"' in report.json_schema(r)
    assert [metrics_row.status for metrics_row in scan(repo.limit(0)).status.collect()] == []


def test_metric_rules(spark):
    schema = "sample_id string, gold string, prediction string, status string"
    m = metrics.overall(spark.createDataFrame([], schema)).first()
    assert m.sample_count == 0 and m.precision is m.recall is m.f1 is m.complete_run_rate is None
    rows = [("1", "INCONSISTENT", "UNCERTAIN", "FAILED"), ("2", "CONSISTENT", "CONSISTENT", "COMPLETED"), ("3", "CONSISTENT", "SKIPPED", "COMPLETED"), ("4", "CONSISTENT", "UNCERTAIN", "PARTIAL"), ("5", "CONSISTENT", "INCONSISTENT", "COMPLETED"), ("6", "INSUFFICIENT", "INCONSISTENT", "COMPLETED")]
    m = metrics.overall(spark.createDataFrame(rows, schema)).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.improper_confirmation) == (0, 1, 3, 1, 1) and m.explicit_consistency_rate == 0.25 and m.precision == 0.0 and m.recall == 0.0
    bad = metrics.violations(spark.createDataFrame([("1", "X", "CONSISTENT", "FAILED"), ("1", "CONSISTENT", "Y", "Z"), (None, "CONSISTENT", "SKIPPED", "FAILED")], schema)).collect()
    assert {v.violation for v in bad} == {"UNKNOWN_GOLD", "FAILED_BUT_DEFINITE", "DUPLICATE_ID", "UNKNOWN_PREDICTION", "UNKNOWN_STATUS", "EMPTY_ID"}
    with pytest.raises(ValueError):
        metrics.recall_at(spark.createDataFrame([(1,)], "min_rank int"), [1, 1])


def test_budget_is_greedy(spark):
    f = spark.createDataFrame([("r", "a.py", 4), ("r", "b.py", 8), ("r", "c.py", 2)], "repo_id string, path string, size long")
    assert {r.path for r in snapshot.admit(f, 6).where("admitted").collect()} == {"a.py", "c.py"}
    f = spark.createDataFrame([("a.py",), ("skip.py",), ("guide.md",), ("x/.md",), (".md",), ("node_modules/a.py",), ("a/../b.py",), ("a.py/",)], "path string")
    got = {r.path: r.v for r in f.select("path", snapshot.file_verdict(F.col("path"), F.lit(1), include=["**/*.py"], exclude=["skip.py"]).alias("v")).collect()}
    assert got == {"a.py": None, "skip.py": "EXCLUDED", "guide.md": "EXCLUDED", "x/.md": "UNSUPPORTED", ".md": "UNSUPPORTED", "node_modules/a.py": "EXCLUDED", "a/../b.py": "UNSAFE_PATH", "a.py/": "UNSUPPORTED"}


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "demo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in {"client.py": C60, "docs/d é.md": states("30"), "big.md": "x" * 3000}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "link.md").symlink_to("client.py")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "client.py").write_text("def connect(timeout=30): pass\n")
    return root


def test_git_source(spark, repository):
    rows = {r.path: r for r in git.read_repository(spark, str(repository), max_file_bytes="2000").collect()}
    assert set(rows) == {"client.py", "docs/d é.md", "big.md", "link.md"}
    assert bytes(rows["client.py"].content).decode() == C60 and rows["big.md"].content is None and rows["link.md"].mode == "120000"
    assert git.is_dirty(str(repository)) and len(git.resolve_ref(str(repository), "HEAD")) == 40
    for bad in ("", "-x", "nope", "a\0b"):
        with pytest.raises(git.SourceError, match="MISSING_REF"):
            git.resolve_ref(str(repository), bad)
    now = {r.path: bytes(r.content) for r in git.read_working_tree(spark, str(repository)).collect()}
    assert now["client.py"] == b"def connect(timeout=30): pass\n" and "docs/d é.md" in now


def test_command_line(spark, repository, tmp_path, capsys):
    from plumbline.__main__ import doctor, main

    assert main(["scan", str(repository), "--out", str(tmp_path / "o")]) == 1
    assert main(["scan", str(repository), "--out", str(tmp_path / "o")]) == 2 and "OUTPUT_EXISTS" in capsys.readouterr().err
    assert main(["patch", str(repository), "--out", str(tmp_path / "p")]) == 0
    assert "+`timeout` 默认值为 `60`。" in (tmp_path / "p/fixes.diff").read_text()
    assert main(["scan", str(repository), "--working-tree", "--out", str(tmp_path / "w")]) == 0
    assert all(c["status"] == "OK" for c in doctor())


def test_files_and_configuration(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"sample_id": "1", "gold": "CONSISTENT"}\n\n{"sample_id": "2"}\n')
    assert source_files.read_jsonl(spark, str(tmp_path / "p.jsonl"), source_files.PREDICTIONS).count() == 2
    (tmp_path / "q.jsonl").write_text('{"sample_id": "1", "other": 2}\n')
    with pytest.raises(Exception, match="unknown keys"):
        source_files.read_jsonl(spark, str(tmp_path / "q.jsonl"), source_files.PREDICTIONS).collect()
    (tmp_path / "r.csv").write_bytes(b"\xef\xbb\xbfsample_id,reviewer\n1,anna\n")
    assert source_files.read_reviews(spark, str(tmp_path / "r.csv")).first().asDict() == {"sample_id": "1", "reviewer": "anna"}
    (tmp_path / "c.toml").write_text('[scan]\ntop_k = 3\n[[ignore]]\nreason = "x"\nexpires = 2024-01-01\n')
    c = source_files.load_config(tmp_path / "c.toml")
    assert c.top_k == 3 and c.ignores[0].expires == date(2024, 1, 1) and source_files.load_config() == Config()
    for text in ("[scan]\ntop_k = 0\n", "[scan]\nplugins = 1\n", "[other]\n"):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(git.SourceError, match="INVALID_CONFIG"):
            source_files.load_config(tmp_path / "bad.toml")


def test_stream_of_snapshots(spark, tmp_path):
    from plumbline.streaming.snapshots import read_snapshots, scan_stream

    (tmp_path / "in").mkdir()
    files(spark, {"client.py": C60, "d.md": states("30")}).withColumn("arrived", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = scan_stream(read_snapshots(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda r, i: seen.append((i, r.findings.count())))
    query.awaitTermination(120)
    assert [n for _, n in seen] == [1]


def test_provider_faults_stay_undecided(spark):
    from plumbline.operators.align import align
    from plumbline.operators.extract import extract_claims, extract_code
    from plumbline.operators.judge import judge_with_provider

    repo = files(spark, {"client.py": C60, "d.md": states("30") + "\n`timeout` defaults to 31.\n`timeout` defaults to 32.\n"})

    class Fake:
        def judge(self, claim, facts):
            if "31" in claim["quote"]:
                raise RuntimeError("TIMEOUT")
            cited = ["other"] if "32" in claim["quote"] else [facts[0]["fact_id"]]
            return {"decision": "INCONSISTENT", "reason_code": "MODEL", "fact_ids": cited}

    got = sorted(r.reason_code for r in judge_with_provider(align(extract_claims(repo).claims, extract_code(repo).facts), Fake).collect())
    assert got == ["INVALID_RESPONSE", "MODEL", "TIMEOUT"]


def test_viewer_comparison(spark):
    base = {"repo_id": "r", "head_sha": "h", "mode": "rules", "config_hash": "c", "enabled_types": ["a", "b", "a"], "run_id": "1"}
    other = base | {"run_id": "2", "enabled_types": ["b", "a"]}
    df = spark.createDataFrame([(base, other, base | {"head_sha": "x", "run_id": "3"})], "a struct<repo_id:string,head_sha:string,mode:string,config_hash:string,enabled_types:array<string>,run_id:string>, b struct<repo_id:string,head_sha:string,mode:string,config_hash:string,enabled_types:array<string>,run_id:string>, c struct<repo_id:string,head_sha:string,mode:string,config_hash:string,enabled_types:array<string>,run_id:string>")
    assert tuple(df.select(viewer.comparable("a", "b"), viewer.comparable("a", "a"), viewer.comparable("a", "c")).first()) == (True, False, False)
    assert [r.n for r in viewer.page(spark.range(30).select(F.col("id").alias("n")), 9, F.col("n")).collect()] == list(range(24, 30))
