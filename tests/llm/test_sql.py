"""Every registered query of the subpackage against its SQL, on whole small tables; and what is registered."""

import duckdb
import pytest

from millrace.llm import entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_registered_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in want.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple((x is not None, plain(x)) for x in r)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want.fetchall()))


def test_one_query_for_each_operator():
    names = list(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in names if n != "pipeline"] == list(range(1, 11)) and "pipeline" in names
