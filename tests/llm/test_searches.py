"""Licence scans and benchmark decontamination against brute force, with planted passages and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import prose

from plumbline.llm import decontaminate, license_scan
from plumbline.llm.license_texts import TEMPLATES


def tokens(text):
    return re.findall(r"\w+", text.lower())


@pytest.mark.parametrize("text", ["", "  ", "One two_three 4-5", "É ß İx 日本語, 😀 a", "tab\tline\nend", "'quoted' x's"])
def test_word_hashes_follow_the_word_pattern(text):
    h = decontaminate.WordHashes()
    hashes, starts, ends = h.places(text)
    low = text.lower()
    assert [low[a:b] for a, b in zip(starts, ends)] == re.findall(r"\w+", low)
    assert len(set(hashes.tolist())) == len(set(re.findall(r"\w+", low)))


def test_licences_are_found_and_clean_texts_left(spark, edge_docs, no_docs):
    names = sorted(TEMPLATES)
    rows = [(i, prose(i, 300) + "\n" + TEMPLATES[n] + "\n" + prose(i + 50, 200)) for i, n in enumerate(names)]
    rows += [(100 + i, prose(200 + i, 400)) for i in range(20)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert {(i, n) for i, n in enumerate(names)} <= found
    assert not any(d >= 100 for d, _ in found)
    assert all(r.containment >= 0.8 for r in got)
    assert license_scan.scan_licenses(edge_docs, TEMPLATES).collect() == []
    assert license_scan.scan_licenses(no_docs, TEMPLATES).collect() == []
    with pytest.raises(ValueError, match="words"):
        license_scan.Library({"short": "MIT License"}, license_scan.Scan())


def test_retrieval_misses_nothing_that_brute_force_finds():
    library, h, r = license_scan.Library(TEMPLATES, license_scan.Scan()), decontaminate.WordHashes(), random.Random(1)
    lists = []
    for name in sorted(TEMPLATES) * 4:
        words = tokens(TEMPLATES[name])
        for _ in range(int(len(words) * 0.04 * r.random())):
            words[r.randrange(len(words))] = f"zzz{r.randrange(99)}"
        around = tokens(prose(r.randrange(999), 120))
        at = r.randint(0, len(around))
        lists.append(h(" ".join(around[:at] + words + around[at:])))
    lists += [h(""), h("a b"), h(TEMPLATES["MIT notice"])]
    assert library.search(lists) == library.search(lists, every_window=True)


def edit_distance(pattern, text):
    """Least edits between the pattern and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items():
    return [(i, prose(1000 + i, n)) for i, n in enumerate([14, 18, 25, 31, 37, 44, 59, 20, 33, 50])]


def test_bit_parallel_distance_is_exact(items):
    index, r = decontaminate.Index(items, decontaminate.Search()), random.Random(5)
    for i, (_, text) in enumerate(items):
        words = index.words[i].tolist()
        region = words[:]
        for _ in range(r.randint(0, 12)):
            at = r.randrange(len(region))
            r.choice([lambda: region.pop(at), lambda: region.insert(at, r.getrandbits(60)), lambda: region.__setitem__(at, r.getrandbits(60))])()
        region = [r.getrandbits(60) for _ in range(5)] + region + [r.getrandbits(60) for _ in range(4)]
        assert index.distance(i, np.array(region, np.uint64)) == edit_distance(words, region)


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.05, 0.97), (0.1, 0.95)])
def test_recall_reaches_its_target(items, share, least):
    search = decontaminate.Search()
    index, h, r = decontaminate.Index(items, search), decontaminate.WordHashes(), random.Random(7)
    lists, truth = [], []
    for rep in range(60):
        for i, (_, text) in enumerate(items):
            words = tokens(text)
            for _ in range(int(share * len(words))):
                at = r.randrange(len(words))
                r.choice([lambda: words.pop(at), lambda: words.insert(at, f"new{r.randrange(999)}"), lambda: words.__setitem__(at, f"new{r.randrange(999)}")])()
            around = tokens(prose(rep, 200))
            at = r.randint(0, len(around))
            lists.append(h(" ".join(around[:at] + words + around[at:])))
            truth.append(i)
    got = {(t, i) for t, i, _ in index.search_texts(lists)}
    assert np.mean([(t, i) in got for t, i in enumerate(truth)]) >= least


def test_results_are_exactly_verified(spark, items, edge_docs, no_docs):
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "?!"), (93, items[3][1])], "item_id long, text string")
    rows = [(i, prose(i, 150) + " " + t.upper().replace(" ", " | ") + " " + prose(i + 77, 90)) for i, t in items] + [(50 + i, prose(3000 + i, 500)) for i in range(10)] + [(99, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for d, text in rows:
        for i, item in [*items, (93, items[3][1])]:
            e = edit_distance(tokens(item), tokens(text))
            if e <= int(0.1 * len(tokens(item))):
                want[d, i] = e
    assert got == want and len(want) == 12
    kept = decontaminate.reject_leaks(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [50 + i for i in range(10)]
    assert decontaminate.find_leaks(edge_docs, bench).collect() == [] == decontaminate.find_leaks(no_docs, bench).collect()
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.reject_leaks(edge_docs, bench).columns == edge_docs.columns


def test_blocks_of_items_change_nothing(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    one = {tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()}
    many = {tuple(r) for r in decontaminate.find_leaks(docs, bench, decontaminate.Search(block=3)).collect()}
    assert one == many and len(one) == len(items)


@pytest.mark.parametrize("n", [2, 3, 9, 10, 12, 15, 61, 300, 1000, 2000])
def test_recall_at_every_length_and_in_every_batch(n):
    items = [(i, prose(7000 + 10 * n + i, n)) for i in range(4)]
    index, h, r = decontaminate.Index(items, decontaminate.Search()), decontaminate.WordHashes(), random.Random(n)
    lists, truth = [], []
    for share in (0.0, 0.03, 0.06, 0.1):
        for rep in range(15 if n < 1000 else 4):
            for i, (_, text) in enumerate(items):
                words = tokens(text)
                for _ in range(int(share * n)):
                    at = r.randrange(len(words))
                    r.choice([lambda: words.pop(at), lambda: words.insert(at, f"new{r.randrange(999)}"), lambda: words.__setitem__(at, f"new{r.randrange(999)}")])()
                around = tokens(prose(rep, 150))
                at = r.randint(0, len(around))
                lists.append(h(" ".join(around[:at] + words + around[at:])))
                truth.append(i)
    got = index.search_texts(lists)
    found = {(t, i) for t, i, _ in got}
    assert np.mean([(t, i) in found for t, i in enumerate(truth)]) >= 0.95
    assert got == [(t, i, d) for t, w in enumerate(lists) for _, i, d in index.search_texts([w])]
    order = list(range(len(lists)))
    r.shuffle(order)
    assert got == sorted((order[t], i, d) for t, i, d in index.search_texts([lists[t] for t in order]))


def best_passage(text, template, words=5, share=0.8):
    """Most shingles of the template in a run of at most 1.2 times their number, and the first word of the earliest such run, by trying all."""
    own = {tuple(t[i : i + words]) for t in [tokens(template)] for i in range(len(t) - words + 1)}
    sh = [tuple(text[i : i + words]) for i in range(len(text) - words + 1)]
    longest = -(-len(own) * 12 // 10)
    runs = [(len(own & set(sh[a : a + longest])), -a) for a in range(len(sh)) if sh[a] in own]
    best = max(runs, default=(0, 0))
    return (round(best[0] / len(own), 6), -best[1]) if best[0] >= share * len(own) else None


def test_licences_equal_an_independent_brute_force(spark):
    r, rows = random.Random(3), []
    for k, name in enumerate(sorted(TEMPLATES) * 3):
        words = tokens(TEMPLATES[name])
        for _ in range(int(len(words) * 0.05 * r.random())):
            words[r.randrange(len(words))] = f"zzz{r.randrange(99)}"
        around = tokens(prose(k, 150))
        at = r.randint(0, len(around))
        rows.append((k, " ".join(around[:at] + words + around[at:] + (words if k % 4 == 0 else []))))
    rows += [(None, rows[0][1]), (1, rows[1][1]), (500, prose(4, 120_000) + " " + TEMPLATES["MIT notice"]), (501, "\u00c9\u0130 " * 40 + rows[2][1])]
    want = {}
    for n, (_, text) in enumerate(rows):
        have = tokens(text)
        for name in TEMPLATES:
            if len(have) < 5000 or name == "MIT notice":
                hit = best_passage(have[-3000:] if len(have) > 5000 else have, TEMPLATES[name])
                if hit:
                    want[n, name] = (hit[0], hit[1] + (len(have) - 3000 if len(have) > 5000 else 0))
    library, h = license_scan.Library(TEMPLATES, license_scan.Scan()), decontaminate.WordHashes()
    lists = [h(t) for _, t in rows]
    got = library.search(lists)
    assert {(t, library.names[i]): (round(s, 6), at) for t, i, s, at in got if rows[t][0] != 500 or library.names[i] == "MIT notice"} == want and len(want) > 20
    assert got == [(t, i, s, at) for t, w in enumerate(lists) for _, i, s, at in library.search([w])]
    clash = spark.createDataFrame([(d, t, "x", 1.0, 2) for d, t in rows], "doc_id long, text string, license string, containment double, first_word int")
    out = license_scan.scan_licenses(clash.repartition(3), TEMPLATES).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, license_scan.scan_licenses(clash.coalesce(1), TEMPLATES).collect())) and len(out) == len(got)
    assert sum(r.doc_id is None for r in out) and sum(r.doc_id == 1 for r in out) >= 2


def test_leaks_in_repeated_rows_null_ids_clashing_columns_and_other_types(spark, items):
    hit = prose(1, 80) + " " + items[2][1] + " " + prose(2, 80)
    long_hit = prose(3, 400_000) + " " + items[4][1]
    rows = [(1, hit, 5, 1.0, 1), (1, hit, 5, 1.0, 1), (None, hit, None, None, None), (2, long_hit, 5, 1.0, 1), (3, prose(5, 90), 5, 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, distance double, item int")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 2, 0, 25), (1, 2, 0, 25), (None, 2, 0, 25), (2, 4, 0, 37)], key=str)
    for table in (docs, docs.withColumn("text", F.col("text").cast("binary"))):
        kept = decontaminate.reject_leaks(table, bench)
        assert kept.schema == table.schema and [r.doc_id for r in kept.collect()] == [3]
