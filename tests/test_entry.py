"""The driver's contract."""

import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from palinode.plans.oracle import oracle_sql as core_sql

DATA = Path("/root/testdata/sf0.001")


def test_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 31


def agrees(spark, name):
    """Whether a query gives the rows of its SQL on the smallest tables."""
    entry = importlib.import_module("__spark_entry__")
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    got = entry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query_against_sql(spark, name):
    assert agrees(spark, name)


def test_nothing_else_needs_the_training_data_part():
    code = "import sys; sys.modules['palinode.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
