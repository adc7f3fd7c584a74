import os

import duckdb
import pytest

import seasight.plans.coast  # noqa: F401  (registers its queries)
import seasight.plans.frames  # noqa: F401  (likewise)
import seasight.plans.more  # noqa: F401  (likewise)
import seasight.plans.patches  # noqa: F401  (likewise)
import seasight.plans.regions  # noqa: F401  (likewise)
from seasight.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def rows(pdf):
    return sorted(map(str, pdf[sorted(pdf.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
