"""URL filter, WARC archives and chat formatting against plain Python."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format, url_filter, warc

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?q#f", "https://example.net/de/81", "x://h?q/p", "a://b#c", "http://É.ORG/es/ü", "http://com/en/", "http://notexample.com/en/71", "ftp://u@h.example.com:80/en/7", "http://a.net/de/8", "//x/y", "http://x.com/en", "m://a.b://c/d"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:end]


def rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_edges(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], None, None), (None, URLS[4], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, n long")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.judge_urls(pages, none).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path = split(URLS[r.page_id])
            r_ = rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, r_.name if r_ else None)
            assert r.verdict == (r_.verdict if r_ else "allow")
            assert r.rate == 0.5
    assert url_filter.judge_urls(pages.limit(0), none).collect() == []


def test_reputation_shrinks_hosts_to_their_domain(spark):
    pages, outcomes, n = [], [], 0
    for host, bad, good, open_ in [("a.bad.example", 60, 2, 5), ("new.bad.example", 0, 0, 5), ("b.bad.example", 40, 1, 1), ("a.fine.example", 1, 80, 5), ("one.fine.example", 1, 0, 5), ("b.fine.example", 0, 60, 0)]:
        for k in range(bad + good + open_):
            pages.append((n, f"http://{host}/x{k}"))
            if k < bad + good:
                outcomes.append((n, int(k < bad)))
            n += 1
    outcomes += [(0, 0), (1, None), (None, 1)]
    got = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert got["a.bad.example"].verdict == "block" and got["a.fine.example"].verdict == "allow"
    assert got["one.fine.example"].verdict == "allow" and got["one.fine.example"].rate < 0.6
    assert got["new.bad.example"].rate > 0.5 > got["a.fine.example"].rate


def test_domains_under_long_suffixes_are_apart(spark):
    pages = [(i, f"http://www.{'bad' if i % 2 else 'good'}.co.in/{i}") for i in range(80)] + [(i, f"http://x.{'bad' if i % 2 else 'good'}.odd.example/{i}") for i in range(80, 160)]
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(160)], "page_id long, bad int")
    table = spark.createDataFrame(pages, "page_id long, url string")
    for suffixes in (url_filter.LONG_SUFFIXES, ("odd.example",)):
        got = {r.host: r.verdict for r in url_filter.judge_urls(table, outcomes, suffixes_of_two=suffixes).collect()}
        assert got["www.bad.co.in"] == got["x.bad.odd.example"] == "block" and got["www.good.co.in"] == "allow"
    host = spark.createDataFrame([("a.b.co.in",), ("co.in",), ("b.odd.example",), ("",)], "h string")
    assert [tuple(r) for r in host.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()] == [("b.co.in", "co.in"), ("co.in", "co.in"), ("odd.example", "example"), ("", "")]


def read_back(data):
    return list(warc.parse_records(io.BytesIO(data)))


def test_records_and_framing():
    for n in (0, 1, 4096, 4097, 100_000):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.decode_chunked(warc.encode_chunked(payload, 4096)) == payload
        found = read_back(b"".join(warc.records_of("n", "http://x/ y\r\n", payload, None, warc.Layout())))
        block = b"".join(b for _, b in found)
        assert warc._payload(block) == payload
        assert len(found) == (1 if len(block) <= 16384 else -(-len(block) // 16384))
        if len(found) > 1:
            assert [int(h[b"warc-segment-number"]) for h, _ in found] == list(range(1, len(found) + 1))
            assert int(found[-1][0][b"warc-segment-total-length"]) == len(block)
    assert warc.decode_chunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.decode_chunked(bad)
    with pytest.raises(ValueError, match="ends within"):
        read_back(b"".join(warc.records_of("n", "u", b"x" * 100, None, warc.Layout()))[:-40])


def test_archives_round_trip(spark):
    big = "long page " * 9000
    rows = [(4, "u", "same", 1, "c"), (2, "u", "same", 1, "c"), (3, None, None, 1, "c"), (5, "u", "", None, None), (7, "x y\n", big, 1, "c"), (6, "u", big + "é", 1, "c"), (9, "u", big, 1, "c"), (9, "u", big, 1, "c"), (None, "u", "q", 1, "c"), (None, "u", "same", 1, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long, name string")
    got = sorted((tuple(r) for r in warc.archive_pages(pages).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own = {}
    for i, _, html, *_x in rows:
        own[html or ""] = min(own.get(html or "", i) if own.get(html or "", i) is not None else i or 10**9, i if i is not None else 10**9)
    want = []
    for i, _, html, *_x in rows:
        data = (html or "").encode()
        o = own[html or ""] if own[html or ""] != 10**9 else None
        want.append((i, len(data), warc.digest_of(data), "response" if i == o else "revisit", None if i == o else o))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert warc.archive_pages(pages.limit(0)).collect() == []
    small = {r.page_id: r.record_type for r in warc.archive_pages(pages.where("page_id in (2, 4, 7)").union(pages.where("page_id = 9").limit(1)), least_bytes=100).collect()}
    assert small == {2: "response", 4: "response", 7: "response", 9: "revisit"}


def test_lost_or_doubled_segments_fail(spark):
    folder = warc.shared_dir(spark)
    records = list(warc.records_of("n", "u", b"y" * 50_000, None, warc.Layout()))
    for name, part in (("lost", records[:1] + records[2:]), ("double", [*records, records[1]]), ("cut", records[:-1])):
        path = f"{folder}/{name}.warc.gz"
        with open(path, "wb") as f:
            f.write(b"".join(part))
        with pytest.raises(Exception, match="segment|bytes, the last"):
            warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()


def test_ids_of_any_text_come_back(spark):
    ids = ["a:b", "a:c", "null", None, "", "a%3Ab", "é 日\n+", "id-a", "x" * 300]
    pages = spark.createDataFrame([(i, "u", f"page {n}") for n, i in enumerate(ids)] + [(i, "u", "same") for i in ids[:5]], "page_id string, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert sorted((repr(r.page_id), r.payload_digest) for r in got if r.record_type == "response" and r.payload_bytes == 6) == sorted((repr(i), warc.digest_of(f"page {n}".encode())) for n, i in enumerate(ids))
    assert sorted((repr(r.page_id), r.refers_to) for r in got if r.payload_bytes == 4) == sorted([("''", None), ("'a:b'", ""), ("'a:c'", ""), ("'null'", ""), ("None", "")])


def test_archives_are_read_side_by_side_and_from_file_uris(spark, monkeypatch):
    pages = spark.range(60).selectExpr("id page_id", "'u' url", "repeat(cast(id as string), 2000) html")
    base = warc.shared_dir(spark)
    monkeypatch.setattr(warc, "shared_dir", lambda _: "file:" + base.removeprefix("file:"))
    manifest = warc.write_archives(pages.selectExpr(f"'{warc.NAME}id-' || page_id || ':x' name", "url", "cast(html as binary) payload", "cast(null as string) refers_to").repartition(12), warc.Layout(file=10_000))
    files = manifest.count()
    assert files > 8 and manifest.first().path.startswith("file:///")
    read = manifest.select("path").repartition(min(files, warc.READERS)).mapInArrow(warc._read_files, warc.READ)
    assert read.rdd.getNumPartitions() == files
    assert warc.read_archives(manifest).count() == 60 == warc.archive_pages(pages).count()


def test_revisits_without_their_response(spark):
    path = f"{warc.shared_dir(spark)}/revisits.warc.gz"
    with open(path, "wb") as f:
        f.write(b"".join([*warc.records_of("here", "u", b"abc", None, warc.Layout()), *warc.records_of("good", "u", b"abc", "here", warc.Layout()), *warc.records_of("lone", "u", b"xyz", "gone", warc.Layout())]))
    manifest = spark.createDataFrame([(path,)], "path string")
    with pytest.raises(Exception, match="no response for revisits of gone"):
        warc.read_archives(manifest).collect()
    got = {r.name: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest, strict=False).collect()}
    assert got == {"here": ("response", None, 3, warc.digest_of(b"abc")), "good": ("revisit", "here", 3, warc.digest_of(b"abc")), "lone": ("revisit", "gone", None, warc.digest_of(b"xyz"))}
    assert warc.read_archives(manifest.limit(0)).collect() == []


CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 1, "assistant", "second"), (2, 0, "user", "first"),
    (3, 0, "user", r"</s>[INST] \ \\l <s> [ROLE x] [/ROLE] [/SYS]"), (3, 1, "assistant", r"\b[OUT] <\s> [[INST] \\"),
    (4, 0, "assistant", None), (5, 0, None, "who"), (6, 0, "to]ol[\\", "x"), (7, None, "user", "b"), (7, None, "user", "a"), (7, 0, "user", "a"),
    (8, 0, "user", "z" * 100_000), (8, 1, "assistant", "😀\né" * 1000), (None, 0, "user", "n"),
]


def brute_digest(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
    return len(turns), sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)), len(loss), sha(loss)


def test_chats_are_read_back(spark):
    rows = [(*c, "clash", 5) for c in CHATS]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, loss long")
    formatted = chat_format.format_chats(chats)
    got = {r.conv_id: r for r in chat_format.chat_digests(formatted).collect()}
    texts = {r.conv_id: "".join(s.text for s in r.segments) for r in formatted.collect()}
    assert set(got) == {c[0] for c in CHATS}
    for conv, r in got.items():
        turns = [c[1:] for c in CHATS if c[0] == conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_digest(turns), conv
        assert r.formatted_chars == len(texts[conv])
    assert {c for c, r in got.items() if r.valid} == {1, 2, 3, 8}
    assert texts[3].count("</s>") == 1 and texts[3].count("[INST]") == 1
    assert chat_format.format_chats(chats.limit(0)).collect() == []


def test_escapes_are_reversible(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    bits = ["\\", "<", "[", "]", "l", "b", "c", "</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[OUT]", "[ROLE", " ", "x", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in chat_format.TEMPLATE.controls())
