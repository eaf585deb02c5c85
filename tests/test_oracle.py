"""Every query of the catalogue against its SQL."""

import glob
from pathlib import Path

import duckdb
import pytest

from rowforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(t).stem} AS SELECT * FROM '{t}'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
