import subprocess
import sys

import duckdb
import pytest

from folioflow import queries as q

from .conftest import ROOT


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(q.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_training_subpackage(tmp_path):
    """The other queries load where the training-data modules are gone."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
