"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    out = catalogue.QUERIES[name](spark, SF)
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(out.columns)
    want = sorted(repr(sorted(zip(columns, r))) for r in found.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in out.collect()) == want and want


def test_entry_and_names(spark):
    assert {"run_findings", "patch_rescan"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
