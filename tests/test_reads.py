"""How often files are read, and what a task holds of them: neither may grow faster than the files."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from helpers import files, states
from plumbline.operators import extract
from plumbline.operators.schemas import CLAIMS, SCANNED_CODE
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def reads(monkeypatch, tmp_path):
    """Calls give how often each path was read so far."""
    log = str(tmp_path / "reads")
    open(log, "w").close()

    def counted(read):
        def run(repo_id, path, data):
            with open(log, "a") as f:
                f.write(f"{repo_id}/{path}\n")
            return read(repo_id, path, data)

        return run

    for name in ("read_source", "read_document"):
        monkeypatch.setattr(extract, name, counted(getattr(extract, name)))
    return lambda: Counter(open(log).read().split())


def test_arrays_are_what_pyarrow_makes_of_rows():
    rows = [extract.read_source("r", "a.py", b"def f(x=1, *, y=()): pass\n"), extract.read_source("r", "b.py", b"def (\n"), {"repo_id": None, "entities": None, "facts": [], "imports": [None], "diagnostics": []}]
    schema = to_arrow_schema(SCANNED_CODE)
    made = pa.RecordBatch.from_arrays([extract.to_arrow([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
    made.validate(full=True)
    assert made.equals(pa.RecordBatch.from_pylist(rows, schema=schema)) and CLAIMS


def test_a_task_hands_on_rows_before_it_has_read_its_files(spark, tmp_path, monkeypatch):
    """A task that holds all of a batch's rows reads the last file before the first rows leave it."""
    many = files(spark, {f"p{i}.py": f"def f(x={i}): pass\n" for i in range(1000)}).coalesce(1)
    log, read = str(tmp_path / "n"), extract.read_source

    def counted(*row):
        with open(log, "a") as f:
            f.write("x")
        return read(*row)

    monkeypatch.setattr(extract, "read_source", counted)
    assert len(extract.extract_code(many).entities.limit(10).collect()) == 10
    assert len(open(log).read()) < 1000


def test_alignment_reads_each_file_once_and_verification_once_more(spark, reads):
    catalogue.QUERIES["align_corpus"](spark, SF).collect()
    assert set(reads().values()) == {1}
    before = reads()
    catalogue.QUERIES["verify_findings"](spark, SF).collect()
    assert set((reads() - before).values()) == {2}


def test_names_that_no_claim_uses_are_left_out(spark):
    from plumbline.operators import align

    found = extract.extract_code(files(spark, {f"p{i}.py": "def item(size=1, other=2): pass\n" for i in range(20)})).facts
    claims = extract.extract_claims(files(spark, {"d.md": "# `p3.item`\n\n`size` defaults to `1`.\n"})).claims
    assert align._tops(claims, found, 5).count() == 1
    assert [(r.matches, r.fact.subject) for r in align.align(claims, found).collect()] == [(1, "p3.item")]


def test_more_properties_than_can_be_listed_give_the_same(spark, monkeypatch):
    from plumbline.operators import align

    found = extract.extract_code(files(spark, {"p.py": "def item(size=1, other=2): pass\n"})).facts
    claims = extract.extract_claims(files(spark, {"d.md": "# `p.item`\n\n`size` defaults to `1`.\n\n`other` defaults to `1`.\n"})).claims
    want = sorted(map(repr, align.align(claims, found).collect()))
    monkeypatch.setattr(align, "PROPERTIES", 1)
    assert sorted(map(repr, align.align(claims, found).collect())) == want and len(want) == 2


def test_judgments_alone_read_each_file_once_and_findings_once_more(spark, reads):
    from plumbline.plans.scan import Config, scan

    repo = files(spark, {"c.py": "def connect(timeout=60): return timeout\n", "d.md": states("30")})
    report = scan(repo, Config(exports=False))
    assert report.judgments.count() == 1 and set(reads().values()) == {1}
    assert report.findings.count() == 1 and report.rejected.count() == 0 and report.findings.count() == 1
    assert set(reads().values()) == {2}


def test_proof_of_a_patch_reads_documents_anew_and_code_no_more(spark, reads):
    from plumbline.plans.scan import Config, propose_patches, scan

    repo = files(spark, {"c.py": "def connect(timeout=60): return timeout\n", "d.md": states("30")})
    assert [p.validation for p in propose_patches(scan(repo, Config(exports=False)), Config(exports=False)).collect()] == ["VALIDATED"]
    assert reads() == {"repo/c.py": 2, "repo/d.md": 3}
