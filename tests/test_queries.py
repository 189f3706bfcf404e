"""Every registered query that has SQL gives the rows that DuckDB gives; the others run."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from veritrail.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def canonical(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(canonical, v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    assert len(set(columns)) == len(columns)
    rows = [tuple(canonical(r[c]) for c in columns) for r in frame.collect()]
    if name not in registry.ORACLE_SQL:
        return
    told = duck.execute(registry.ORACLE_SQL[name])
    at = [x[0] for x in told.description]
    assert sorted(at) == columns
    want = [tuple(canonical(r[at.index(c)]) for c in columns) for r in told.fetchall()]
    assert Counter(rows) == Counter(want)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_training_data_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['veritrail.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries()), 'guard'"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
