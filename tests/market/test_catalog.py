"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_every_query_has_sql_but_models_and_a_fold():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"gbt_score", "risk_admission", "walk_forward_auc"}


def test_works_without_the_training_data_package():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['tickloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'mtf_scan' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
