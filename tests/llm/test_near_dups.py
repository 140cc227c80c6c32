"""The pipeline's near-dedup stage against every pair's exact similarity."""

import random

import corpus_pipeline
import pytest
from samples import prose

from plumbline.llm import near_dups, simhash


@pytest.mark.parametrize(("crowd", "pivots", "spread"), [(128, 4, 4096), (2, 4, 3), (2, 1, 4096), (1, 60, 1)])
def test_stage_finds_every_pair_of_similarity(spark, monkeypatch, crowd, pivots, spread):
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    monkeypatch.setattr(near_dups, "PIVOTS", pivots)
    monkeypatch.setattr(near_dups, "SPREAD", spread)
    r = random.Random(4)
    docs = []
    for i in range(40):
        words = prose(i, 100).split()
        docs.append((i, " ".join(words)))
        for k, edits in enumerate((1, 2, 3, 5)):
            changed = list(words)
            for at in r.sample(range(100), edits):
                changed[at] = f"new{at}"
            docs.append((100 * (k + 1) + i, " ".join(changed)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (903, prose(99, 50)), (None, docs[0][1]), (None, docs[0][1])]
    sets = [near_dups.shingles(t or "") for _, t in docs]
    prints = [simhash.fingerprint(t or "", 3) for _, t in docs]
    group = {i: i for i, _ in docs if i is not None}
    far = 0
    for x, (i, _) in enumerate(docs):
        for y, (j, _) in enumerate(docs[:x]):
            near = (prints[x] ^ prints[y]).bit_count() <= 3
            shared = len(set(sets[x].tolist()) & set(sets[y].tolist()))
            alike = shared and shared / (len(sets[x]) + len(sets[y]) - shared) >= 0.8
            if i is not None and j is not None and (near or alike):
                far += bool(alike and not near)
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    assert far > 20
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = [x.doc_id for x in corpus_pipeline.one_of_each_group(spark, table, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(group.values())) and got.count(None) == 2


def test_copies_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    r, compared, counts = random.Random(6), near_dups.compared, []
    base, docs = prose(1, 300).split(), []
    for i in range(240):
        words = list(base)
        for at in r.sample(range(300), r.randrange(36)) if i != 120 else []:
            words[at] = f"new{i}at{at}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(near_dups, "compared", lambda pairs, sets: counts.append(pairs.count()) or compared(pairs, sets))
    got = {x.doc_id for x in near_dups.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [set(near_dups.shingles(t).tolist()) for _, t in docs]
    prints = [simhash.fingerprint(t, 3) for _, t in docs]
    group = list(range(240))
    for x in range(240):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 3 or len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if v == old else v for v in group]
    assert got == set(group) and 1 < len(got) < 200
    assert sum(counts) < 8 * len(docs)
