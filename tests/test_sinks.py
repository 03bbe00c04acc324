import json

from neurospan.sinks import tables as sinks
from neurospan.sources import listing as li
from pyspark.sql import functions as F


def test_sidecar_holds_the_columns_used(spark, tmp_path):
    columns = spark.createDataFrame([("onset", "when"), ("duration", "how long"), ("stim_side", "where")], "column string, description string")
    sinks.write_sidecar(columns, ["onset", "stim_side"], f"file://{tmp_path}/side")
    back = {r["column"]: r["description"] for r in spark.read.json(f"file://{tmp_path}/side").collect()}
    assert back == {"onset": "when", "stim_side": "where"}


def test_records_come_back_with_their_keys(spark, tmp_path):
    df = spark.createDataFrame([("s1", "rest", 0.5, 3), ("s2", "rest", None, 4)], "subject string, task string, score double, n int")
    sinks.write_records(df, f"file://{tmp_path}/qc", "subject")
    back = spark.read.json(f"file://{tmp_path}/qc").select(*df.columns).collect()
    assert sorted(map(tuple, back)) == [("s1", "rest", 0.5, 3), ("s2", "rest", None, 4)]


def test_manifest_appends_each_module_once(spark):
    old = spark.createDataFrame([("a", ["load", "filter"], 1), ("b", ["load"], 2)], "subject_id string, modules array<string>, updated long")
    done = spark.createDataFrame([("a", "filter", 5), ("a", "ica", 7), ("a", "epochs", 6), ("c", "load", 9), ("c", "load", 10)], "subject_id string, module string, time long")
    out = {r["subject_id"]: (r["modules"], r["updated"]) for r in sinks.manifest(old, done).collect()}
    assert out == {"a": (["load", "filter", "epochs", "ica"], 7), "b": (["load"], 2), "c": (["load"], 10)}


def test_participants_and_inclusion(spark, tmp_path):
    files = spark.createDataFrame([("1",), ("sub-1",), ("2",)], "subject string")
    assert sorted(r[0] for r in sinks.participants(files).collect()) == ["sub-1", "sub-2"]
    df = spark.createDataFrame([("1", 10, True), ("2", 20, False), ("3", 30, None)], "subject string, n_epochs int, included boolean")
    sinks.write_inclusion(df, f"file://{tmp_path}/in")
    assert sorted(r["subject"] for r in spark.read.json(f"file://{tmp_path}/in/records").collect()) == ["1", "3"]
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/in/subjects").collect()) == ["1", "3"]


def test_states_are_found_and_malformed_ones_skipped(spark, tmp_path):
    for i, text in enumerate([json.dumps({"subject_id": "1", "status": "completed"}), "{broken", json.dumps({"subject_id": "2", "status": "failed"})]):
        (tmp_path / f"run{i}" / "deep").mkdir(parents=True)
        (tmp_path / f"run{i}" / "deep" / "processing_state.json").write_text(text)
    (tmp_path / "run0" / "other.json").write_text(json.dumps({"subject_id": "9"}))
    assert sorted((r["subject_id"], r["status"]) for r in li.read_states(spark, f"file://{tmp_path}").collect()) == [("1", "completed"), ("2", "failed")]


def test_csv_signals_with_their_events(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3)):
        (tmp_path / f"{name}_data.csv").write_text("E1,E.2\n" + "".join(f"{i},{i / 2}\n" for i in range(n)))
        (tmp_path / f"{name}_event.csv").write_text("latency,type\n2.0,11\n1,12\n")
    long = li.read_csv_signal(spark, f"file://{tmp_path}/*_data.csv")
    assert long.count() == 806
    assert long.filter("channel = 'E1' and value <> sample_idx or channel = 'E.2' and 2 * value <> sample_idx").count() == 0
    ev = li.read_csv_events(spark, f"file://{tmp_path}/*_event.csv")
    at = ev.join(long.filter("channel = 'E1'"), (ev["file"] == long["file"]) & (F.col("sample") == F.col("sample_idx")))
    assert sorted((r["type"], r["value"]) for r in at.collect()) == [(11, 2.0), (11, 2.0), (12, 1.0), (12, 1.0)]


def test_all_runs_are_written_at_once(spark, tmp_path):
    rows = [("sub-1_run-1", 2.0, 0.5, "go", 0.3, None), ("sub-1_run-1", 1.0, 0.5, "stop", None, "left"), ("sub-2_run-1", 0.25, 1.0, "go", 0.7, "right"), (None, 9.0, 9.0, "lost", None, None)]
    trials = spark.createDataFrame(rows, "run string, onset double, duration double, trial_type string, response_time double, side string").repartition(3)
    columns = spark.createDataFrame([("onset", "when"), ("side", "where"), ("other", "none")], "column string, description string")
    sinks.write_runs(trials, columns, f"file://{tmp_path}/out", "run")
    files = sorted(tmp_path.glob("out/events/run=*/*.csv"))
    assert [f.parent.name for f in files] == ["run=sub-1_run-1", "run=sub-2_run-1"]
    assert files[0].read_text().splitlines() == ["onset\tduration\ttrial_type\tresponse_time\tside", "1.000000\t0.500000\tstop\tn/a\tleft", "2.000000\t0.500000\tgo\t0.300000\tn/a"]
    assert {r["column"] for r in spark.read.json(f"file://{tmp_path}/out/sidecar").collect()} == {"onset", "side"}
    detail = next(tmp_path.glob("out/trials/run=sub-2_run-1/*.csv")).read_text().splitlines()
    assert detail == ["onset\tduration\ttrial_type\tresponse_time\tside", "0.25\t1.0\tgo\t0.7\tright"]
    sinks.write_runs(trials.filter("run is null"), columns, f"file://{tmp_path}/none", "run")
    assert not (tmp_path / "none").exists()


def test_triggers_alone_make_events(spark, tmp_path):
    events = spark.createDataFrame([("r", 500, 11), ("r", 250, 12), (None, 1, 1)], "run string, sample long, code int")
    sinks.write_triggers(events, f"file://{tmp_path}/out", "run", 500.0)
    assert next(tmp_path.glob("out/events/run=r/*.csv")).read_text().splitlines() == ["onset\tduration\ttrial_type\tvalue", "0.500000\t0\ttrigger\t12", "1.000000\t0\ttrigger\t11"]


def test_delivered_recordings_prefer_a_format(spark):
    at = lambda s, kind, name: (f"/raw/{s}/EEG/raw/{kind}_format/{name}{'.mat' if kind == 'mat' else '_data.csv'}",)
    files = [at("NDAR1", "mat", "Video-DM"), at("NDAR1", "csv", "Video-FF"), at("NDAR1", "csv", "RestingState"), at("NDAR2", "mat", "SAIIT_Block2"), at("NDAR2", "mat", "SAIIT_2AFC"), at("X1", "mat", "Video"), ("/raw/NDAR3/EEG/other/Video.mat",), at("NDAR4", "csv", "vislearn__"), at("NDAR4", "mat", "notes")]
    df = spark.createDataFrame(files, "path string")
    got = lambda prefer: sorted((r["subject"], r["paradigm"], r["format"], r["variant"]) for r in li.paradigm_files(df, prefer).collect())
    assert got("mat") == [("NDAR1", "RestingState", "csv", "RestingState"), ("NDAR1", "Video", "mat", "Video_DM"), ("NDAR2", "SAIIT_2AFC", "mat", "SAIIT_2AFC"), ("NDAR2", "SAIIT_2AFC", "mat", "SAIIT_Block2"), ("NDAR4", "vis_learn", "csv", "vislearn_data")]
    assert ("NDAR1", "Video", "csv", "Video_FF_data") in got("csv") and ("NDAR2", "SAIIT_2AFC", "mat", "SAIIT_Block2") in got("csv")
    assert sorted(r["subject"] for r in li.source_subjects(df).collect()) == ["NDAR1", "NDAR2", "NDAR4"]
