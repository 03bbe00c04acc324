"""Every registered query of the library runs on the smallest tables and agrees with its SQL there."""

import math
from pathlib import Path

import duckdb
import pytest

from neurospan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6) + 0.0) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        return
    duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(canon(r[columns.index(c)]) for c in sorted(columns)) for r in duck.fetchall())
    assert sorted(tuple(canon(r[c]) for c in sorted(columns)) for r in rows) == want


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
