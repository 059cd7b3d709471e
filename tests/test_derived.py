import os

import duckdb
import pandas as pd
import pytest

from rolloutlens.plans import calibration, campaigns, chains, compare, derived, difficulty, entities, golds, pools, records, training

SF = "/root/testdata/sf0.001"
PAIRS = derived.QUERIES | entities.QUERIES | compare.QUERIES | golds.QUERIES | chains.QUERIES | records.QUERIES | training.QUERIES | difficulty.QUERIES | calibration.QUERIES | pools.QUERIES | campaigns.QUERIES
NAMES = sorted(k for k, (_, sql) in PAIRS.items() if sql)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def _rows(df):
    text = lambda x: "null" if x is None or x is pd.NA or x != x else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_derived_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entity_names_of_odd_texts(spark):
    rows = [(1, "Boyd's dog saw Ross, boyd and Amy. NASA paid Boyds!"), (2, None), (3, ""), (4, "On Monday Al met Al"), (4, "Jo")]
    got = entities.entity_names(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as names", "1 as w"))
    found = sorted((r["doc_id"], tuple(r["names"])) for r in got.collect())
    assert found == [(1, ("Boyd", "Ross", "Amy")), (2, ()), (3, ()), (4, ("Al",)), (4, ("Jo",))]
    assert entities.entity_names(spark.createDataFrame([], "doc_id long, text string")).count() == 0
