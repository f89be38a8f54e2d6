import duckdb
import pytest

from tickloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_every_number_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
