"""Every catalogue query against its DuckDB SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from zonalis.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    duck.execute(ORACLES[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in duck.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    assert got == want


def test_entry_imports_without_the_training_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['zonalis.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'a02_zonal_summary' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=top, check=False).returncode == 0
