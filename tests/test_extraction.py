"""Extractors, spans, literals and Markdown blocks."""

import inspect
import random

import pytest
from helpers import files

from plumbline.functions.ids import Blob, stable_id
from plumbline.functions.literals import documented_literal, encode_literal, parse_literal
from plumbline.operators.blocks import blocks
from plumbline.operators.code_facts import read_source
from plumbline.operators.doc_claims import read_document


def test_literals():
    assert parse_literal("factory()") is parse_literal("os.getenv('X')") is parse_literal("1 if x else 2") is encode_literal(float("nan")) is encode_literal(b"x") is None
    assert parse_literal("True") != parse_literal("1") and parse_literal("[True]") != parse_literal("[1]") and parse_literal("[1, 2]") != parse_literal("(1, 2)")
    assert parse_literal("{'a': 1, 'b': 2}") == parse_literal("{'b': 2, 'a': 1}") and parse_literal("{2, 1}") == parse_literal("{1, 2}")
    assert parse_literal("None") == {"type": "NoneType", "canonical": '["NoneType",null]'}
    assert parse_literal("-0.0")["canonical"] == '["float",-0.0]' and parse_literal("1" * 5000) is None
    assert parse_literal("[" * 9 + "1" + "]" * 9) is None and parse_literal("[" + "1," * 200 + "]") is None
    assert documented_literal("utf-8") == encode_literal("utf-8") and documented_literal("./cache") and documented_literal("+x") is None and documented_literal("a b") is None


def test_golden_identifiers():
    code = "def connect(timeout=60):\n    return timeout\n"
    out = read_source("r", "api.py", code.encode())
    assert out["entities"][0]["entity_id"] == stable_id("entity", "api.py", "api.connect", "1") == "914cd4163f05055c1a8de814"
    facts = {f["property"]: f for f in out["facts"]}
    assert facts["timeout"]["span"]["start_byte"] == 20 and facts["timeout"]["expression"] == "60"
    assert facts["__signature__"]["expression"] == code.rstrip("\n")
    assert read_source("r", "settings.py", b"CONFIG = {'timeout': 60}\n")["entities"][0]["entity_id"] == "c6045fa4f969425da1343353"


def test_spans_count_bytes_and_lines():
    text = "# `connect`\r\n\r\n说明：`timeout` 默认值为 `30`。\r\n"
    claim = read_document("r", "d.md", text.encode())["claims"][0]
    data, span = text.encode(), claim["value_span"]
    assert data[span["start_byte"] : span["end_byte"]] == b"30" and span["start_line"] == span["end_line"] == 3
    assert claim["quote"] == "说明：`timeout` 默认值为 `30`。"
    blob = Blob("x", b"a\nb\n")
    assert blob.span(0, 2)["end_line"] == 1 and blob.span(0, 3)["end_line"] == 2 and blob.span(2, 2)["start_line"] == 2


def test_diagnostics():
    codes = lambda src: [d["code"] for d in read_source("r", "m.py", src)["diagnostics"]]
    assert codes(b"def (") == ["PYTHON_PARSE_ERROR"] and codes(b"if x:\n    def f(): pass\n") == ["CONDITIONAL_DEFINITION"]
    assert codes(b"@w\ndef f(): pass\n") == ["DYNAMIC_FUNCTION"] and codes(b"def f(): pass\n") == [] and codes(b"def _p(): pass\nclass _C:\n def f(self): pass\n") == []
    doc = lambda text: [(d["code"], d["affects_completeness"]) for d in read_document("r", "d.md", text.encode())["diagnostics"]]
    assert doc("```python\nf(\n```\n") == [("PARTIAL_SNIPPET", False)] and doc("```python\nf()\n") == [("UNCLOSED_FENCE", True)] and doc("") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A\n\nB\n===\n\nC\n---\n", [("heading", 0, 1), ("heading", 2, 4), ("heading", 5, 7)]),
        ("```py\nx\n````\ny\n", [("fence", 0, 3)]), ("~~~\n```\n~~~\n", [("fence", 0, 3)]), ("````\n```\n````\n", [("fence", 0, 3)]), ("``` a`b\nx\n", []),
        ("    code\n\n    more\n\ntext\n    no code\n", [("code", 0, 3)]), ("|a|b|\n|-|-|\n|1|2|\n\nx\n", [("table", 0, 3)]), ("|a|b|\n|-|\n", []), ("a\n|b|c|\n|-|-|\n", []),
        ("> # Q\n> ```\n> x\n> ```\n", [("heading", 0, 1), ("fence", 1, 4)]), ("- a\n\n  ```\n  x\n  ```\n- b\n", [("fence", 2, 5)]), ("1. a\n\n       code\n", [("code", 2, 3)]),
        ("<div>\nx\n\ny\n", [("html", 0, 2)]), ("<!-- a\n\nb -->\nx\n", [("html", 0, 3)]), ("<pre>\n\n</pre>\n", [("html", 0, 3)]), ("***\n---\n", []), ("#no heading\n####### no\n", []), ("\tcode\n", [("code", 0, 1)]),
    ],
)
def test_blocks(text, want):
    assert [(b.kind, b.start, b.end) for b in blocks(text)] == want


def test_tables_and_prose_are_kept_apart():
    text = "# `f`\n\n| Name | Default |\n|---|---|\n| `a` | `1` |\n| b\\|c | 2 |\n| d | 3 | 4 |\n| e f | 5 |\n\n`g` defaults to 6x\n`h` defaults to 7.5.\n\n    `i` defaults to 8\n\n<div>\n`j` defaults to 9\n</div>\n"
    got = [(c["predicate"], c["value"] and c["value"]["canonical"]) for c in read_document("r", "d.md", text.encode())["claims"]]
    assert got == [("h", '["float",7.5]'), ("a", '["int",1]')]


def test_extraction_of_odd_files(spark):
    from plumbline.operators.extract import extract_claims, extract_code

    odd = files(spark, {"a.py": "", "b.py": b"\x00", "c.md": "", "d.md": "x", "e.txt": "def f(a=1): pass", "f.py": "# \U0001f600\ndef f(a='é'): pass\n"})
    code = extract_code(odd)
    assert [(r.property, r.expression) for r in code.facts.orderBy("seq").collect()] == [("a", "'é'"), ("__signature__", "def f(a='é'): pass")]
    assert [(r.path, r.code) for r in code.diagnostics.collect()] == [("b.py", "PYTHON_PARSE_ERROR")]
    assert extract_claims(odd).claims.collect() == [] == extract_claims(odd.limit(0)).claims.collect()


def test_native_binding_equals_real_calls(spark):
    """Random signatures and calls: the Column rules against inspect on real functions, which are called."""
    from pyspark.sql import functions as F

    from plumbline.operators.judge import with_call_reason
    from plumbline.operators.schemas import PARAMETER

    r = random.Random(11)
    rows, want = [], []
    for i in range(400):
        names = r.sample("abcdef", r.randint(0, 5))
        cuts = sorted(r.randint(0, len(names)) for _ in range(2))
        po, pk, ko = names[: cuts[0]], names[cuts[0] : cuts[1]], names[cuts[1] :]
        first = r.randint(0, len(po + pk))
        need = {n: j < first for j, n in enumerate(po + pk)} | {n: r.random() < 0.5 for n in ko}
        va, vk = r.random() < 0.3, r.random() < 0.3
        part = lambda n: n if need[n] else f"{n}=0"
        spec = [part(n) for n in po] + (["/"] if po else []) + [part(n) for n in pk] + (["*v"] if va else ["*"] if ko else []) + [part(n) for n in ko] + (["**w"] if vk else [])
        space: dict = {}
        exec(f"def f({', '.join(spec)}): pass", space)
        count, keywords = r.randint(0, 4), [r.choice("abcdefg") for _ in range(r.randint(0, 3))]
        ok = len(set(keywords)) == len(keywords)
        if ok:
            try:
                space["f"](*[0] * count, **dict.fromkeys(keywords, 0))
            except TypeError:
                ok = False
        params = [(p.name, p.kind.name, p.default is p.empty and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD), "ABSENT", None, None) for p in inspect.signature(space["f"]).parameters.values()]
        rows.append((i, params, count, keywords, False, False))
        want.append("CALL_ACCEPTED" if ok else "CALL_BINDING_ERROR")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("p", T.ArrayType(PARAMETER)), T.StructField("positional_count", T.IntegerType()), T.StructField("keyword_names", T.ArrayType(T.StringType())), T.StructField("unpacking", T.BooleanType()), T.StructField("bound_receiver", T.BooleanType())])
    out = with_call_reason(spark.createDataFrame(rows, schema), F.col("p"), F.lit("none"), F.lit(True)).orderBy("i").collect()
    assert [x.call_reason for x in out] == want
