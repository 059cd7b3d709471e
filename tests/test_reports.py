import os

import duckdb
import pytest

from rolloutlens.plans import reports

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(reports.QUERIES))
def test_report_equals_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)
