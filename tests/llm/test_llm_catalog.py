"""The thirteen queries and the pipeline are registered; those with SQL agree with it on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from neurospan.llm import catalog

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 14))
    assert {*catalog.queries(), "pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(str(r[columns.index(c)]) for c in df.columns) for r in duck.fetchall())
    assert sorted(tuple(str(r[c]) for c in df.columns) for r in df.collect()) == want
