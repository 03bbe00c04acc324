import math

import pytest

from neurospan.operators import models as mo
from neurospan.operators import state as st
from neurospan.sinks.tables import events_table, upsert, write_events
from neurospan.sources import listing as li


def test_critical_r_and_p_values():
    t = 1.984467
    assert abs(mo.t_p_value(t, 98) - 0.05) < 1e-6
    assert abs(mo.critical_r(100, 0.05) - t / math.sqrt(98 + t * t)) < 1e-6
    assert mo.t_p_value(0, 10) == pytest.approx(1)


def test_state_lookup_matches_nulls(spark):
    s = spark.createDataFrame([(1, None, "x"), (1, "01", "y")], "subject int, session string, status string")
    w = spark.createDataFrame([(1, None)], "subject int, session string")
    assert [r["status"] for r in st.lookup(s, w, ["subject", "session"]).collect()] == ["x"]
    assert [r["status"] for r in st.missing(s, w, ["subject", "session"]).collect()] == ["y"]
    assert st.missing(s, w, ["subject", "session"], force=True).count() == 2


def test_upsert_replaces_by_null_safe_key_and_adds_columns(spark):
    old = spark.createDataFrame([(1, None, 1.0), (2, "a", 2.0)], "s int, ses string, f double")
    new = spark.createDataFrame([(1, None, 9.0, "n")], "s int, ses string, f double, g string")
    out = {r["s"]: (r["f"], r["g"]) for r in upsert(old, new, ["s", "ses"]).collect()}
    assert out == {1: (9.0, "n"), 2: (2.0, None)}


def test_events_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 0.5, "x", None, 3), (2.0, None, "y", 0.25, 4)], "onset double, duration double, trial_type string, response_time double, block int")
    assert events_table(df).columns == ["onset", "duration", "trial_type", "response_time", "block"]
    path = f"file://{tmp_path}/events"
    write_events(df, path)
    back = {r["trial_type"]: r for r in li.read_events(spark, path).collect()}
    assert back["x"]["onset"] == "1.500000" and back["x"]["response_time"] is None and back["y"]["duration"] is None


def test_names_and_legacy_tasks(spark):
    df = spark.createDataFrame([("/a/sub-01_ses-2_task-rest_run-3_eeg.fif",), ("sub-x_task-y_eeg",), ("sub-x_eeg.fif",)], "path string")
    out = [tuple(r)[1:] for r in li.parse_names(df).collect()]
    assert out == [("01", "2", "rest", "3", "eeg", ".fif"), ("x", None, "y", None, "eeg", "")]
    from pyspark.sql import functions as F

    names = spark.createDataFrame([(n,) for n in ("saiit2afcblock1", "SurrsuppBlockblock12", "restrun7", "rest")], "n string")
    task, run = li.legacy_task(F.col("n"))
    assert [tuple(r) for r in names.select(task, run).collect()] == [("saiit", "01"), ("Surrsupp", "12"), ("rest", "07"), ("rest", "01")]


def test_file_listing_and_quality_json(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "sub-1_task-r_eeg.json").write_text('{"subject_id": "1", "quality_metrics": {"pct_bad_channels": 3.5}}')
    (tmp_path / "q" / "bad.json").write_text("{nope")
    assert li.list_files(spark, f"file://{tmp_path}/q", "*.json").count() == 2
    df = li.read_quality_json(spark, f"file://{tmp_path}/q")
    assert [r["quality_metrics"]["pct_bad_channels"] for r in df.collect()] == [3.5]


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(103).withColumnRenamed("id", "s")
    a = {r["s"]: r["split"] for r in mo.split_subjects(df, "s", 0.2, 0.1).collect()}
    assert [sum(v == k for v in a.values()) for k in ("test", "validation", "train")] == [20, 10, 73]
    assert a == {r["s"]: r["split"] for r in mo.split_subjects(df.repartition(5), "s", 0.2, 0.1).collect()}


def test_cross_validation_predicts_a_planted_signal(spark):
    rows = [(s, e, float((s * 7919 % 101) / 10 if e == 0 else (s * (e + 3) * 104729 % 97) / 10), float(s * 7919 % 101), s % 4) for s in range(120) for e in range(6)]
    x = spark.createDataFrame(rows, "subject_id int, edge_id int, value double, target double, fold int")
    out = mo.cross_validate(x, 0.5).collect()
    assert len(out) == 120 and max(abs(r["prediction"] - r["target"]) for r in out) < 1e-6
