"""The corpus pipeline on planted cases, components on chains and stars, and the queries' schemas and oracles."""

import random

import corpus_pipeline
import duckdb
import pytest
from samples import prose
from pyspark.sql import functions as F

from plumbline.llm import common, queries
from plumbline.llm.common import connected_components, join_unique, release, spool

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, 999) for i in range(40)] + [(5, 5)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b:
            merged = groups[a] | groups[b]
            for x in merged:
                groups[x] = merged
    assert got == {x: min(g) for x, g in groups.items()}


def test_join_unique_with_a_hot_key(spark):
    left = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(100, 160)] + [(None, 1)], "k long, v long")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("n"), "k"))
    got = join_unique(left, right, "k", "n", parts=10).collect()
    assert len(got) == 560 and all(r.name == f"n{r.k}" for r in got)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    r = random.Random(3)
    item = prose(900, 40)
    docs = [(i, prose(i, 120), "en", "s", 1) for i in range(300)]
    labels = []
    for i in range(300):
        bad = i % 3 == 0
        if bad:
            words = docs[i][1].split()
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["vilescum", "idiotic", "moronish"]))
            docs[i] = (i, " ".join(words), "en", "s", 1)
        labels.append((i, 1, int(bad)))
    docs += [(1000, docs[1][1], "en", "t", 1), (1001, docs[1][1] + " extra", "en", "t", 1), (1002, prose(700, 60) + " " + item + " " + prose(701, 60), "en", "t", 1), (1003, prose(702, 150), "en", "t", 1), (1003, prose(702, 150), "en", "t", 1), (1004, None, None, None, None), (1005, "", None, None, None), (None, prose(703, 90), None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_catches_what_is_planted(spark, planted):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, planted).collect()]
    kept = {i for i in ids if i is not None}
    clean = {i for i in range(300) if i % 3}
    assert len(kept & {i for i in range(300) if i % 3 == 0}) <= 3
    assert len(clean - kept) <= 4
    assert 1 in kept and not {1000, 1001, 1002} & kept
    assert 1003 in kept and ids.count(1003) == 1 and None in ids
    assert len({1004, 1005} & kept) == 1


def test_stages_keep_the_columns(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), planted).collect() == []


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_components_of_a_hub(spark):
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(200_001, 200_011).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = connected_components(hub)
    assert got.groupBy("root").count().orderBy("root").collect() == [(0, 100_001), (200_001, 11)]


def test_spooled_tables_are_deleted(spark):
    import os

    out = spool(spark.range(5), "kept")
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and any(folder.endswith(k.removeprefix("file://")) for k in common._spooled)
    release(out)
    assert not os.path.exists(folder) and not any(folder.endswith(k.removeprefix("file://")) for k in common._spooled)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_their_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    rows = out.collect()
    if name in queries.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "pages", "labels", "conversations", "benchmark"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = db.execute(queries.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(repr(sorted(r.asDict().items())) for r in rows) == sorted(repr(sorted(zip(columns, r))) for r in found.fetchall())
    n = {"op2": "pages", "op3": "pages", "op5": None, "op1": None, "op6": None}.get(name.split("_")[0], "documents")
    if n:
        assert len(rows) == spark.read.parquet(f"{SF}/{n}.parquet").count()
