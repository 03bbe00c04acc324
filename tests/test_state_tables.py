"""State tables, the import of quality records, and run states from batches and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from neurospan.operators import state as st
from neurospan.sinks.store import Conflict, StateTable
from neurospan.streaming import runs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return StateTable(spark, f"file://{tmp_path}/table", ["a", "b"], buckets=4)


def frame(spark, data, schema="a string, b long, x long"):
    return spark.createDataFrame(data, schema)


def test_rows_are_replaced_by_key_and_null_is_a_key(spark, store):
    assert store.read() is None and store.version() == 0
    store.replace(frame(spark, [("p", 1, 10), ("p", None, 20), (None, None, 30)]))
    store.upsert(frame(spark, [("p", None, 21), ("q", 1, 40), (None, None, 31)]))
    assert rows(store.read()) == sorted([("p", 1, 10), ("p", None, 21), (None, None, 31), ("q", 1, 40)], key=repr)
    assert rows(store.read(1)) == sorted([("p", 1, 10), ("p", None, 20), (None, None, 30)], key=repr)
    store.delete(frame(spark, [("p", None, 0), ("z", 9, 0)]))
    assert rows(store.read()) == sorted([("p", 1, 10), (None, None, 31), ("q", 1, 40)], key=repr)


def test_columns_are_added_and_types_stay(spark, store):
    store.replace(frame(spark, [(c, 1, i) for i, c in enumerate("pqrstuvw")]))
    store.upsert(frame(spark, [("p", 1, 7, "note")], "a string, b long, x long, note string"))
    assert store.read().columns == ["a", "b", "x", "note"]
    assert rows(store.read().filter("note is not null")) == [("p", 1, 7, "note")] and store.read().count() == 8
    store.upsert(frame(spark, [("q", 1)], "a string, b long"))
    assert store.read().filter("a = 'q'").first()["x"] is None
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [("p", 1, "text")], "a string, b long, x string"))
    with pytest.raises(ValueError):
        StateTable(spark, store.path, ["a"]).read()


def test_only_touched_buckets_are_written(spark, store):
    store.replace(frame(spark, [(str(i), i, i) for i in range(50)]))
    before = store.commit()["buckets"]
    store.upsert(frame(spark, [("7", 7, 70)]))
    after = store.commit()["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert store.read().agg(F.sum("x")).first()[0] == sum(range(50)) + 63


def test_a_writer_killed_before_its_commit_changes_nothing(spark, store, monkeypatch):
    store.replace(frame(spark, [("p", 1, 10)]))

    def die(self, said):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(StateTable, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(frame(spark, [("p", 1, 99), ("q", 1, 99)]))
        with pytest.raises(KeyboardInterrupt):
            store.replace(frame(spark, []))
    assert store.version() == 1 and rows(store.read()) == [("p", 1, 10)]
    store.upsert(frame(spark, [("q", 1, 11)]))
    assert rows(store.read()) == [("p", 1, 10), ("q", 1, 11)]
    store.vacuum(keep=1)
    assert rows(store.read()) == [("p", 1, 10), ("q", 1, 11)] and store.version() == 2


def test_of_two_writers_one_is_told(spark, store):
    store.replace(frame(spark, [("p", 1, 10)]))
    seen = store.version()
    store.upsert(frame(spark, [("p", 1, 11)]), seen)
    for late in (lambda: store.upsert(frame(spark, [("p", 1, 12)]), seen), lambda: store.replace(frame(spark, []), seen), lambda: store.delete(frame(spark, [("p", 1, 0)]), seen)):
        with pytest.raises(Conflict):
            late()
    assert rows(store.read()) == [("p", 1, 11)]
    calls = []

    def step(table, version):
        calls.append(version)
        if len(calls) == 1:
            table.upsert(frame(spark, [("r", 1, 1)]))  # another writer in between
        return table.upsert(frame(spark, [("q", 1, 2)]), version)

    assert store.change(step) == 4 and calls == [2, 3]
    assert rows(store.read()) == [("p", 1, 11), ("q", 1, 2), ("r", 1, 1)]


def test_older_rows_and_repeated_batches_change_nothing(spark, store):
    store.upsert(frame(spark, [("p", 1, 10), ("p", 1, 12), ("q", 1, 5)]), order="x", stream=("s", 0))
    store.upsert(frame(spark, [("p", 1, 11), ("q", 1, 6)]), order="x", stream=("s", 1))
    assert rows(store.read()) == [("p", 1, 12), ("q", 1, 6)]
    assert store.upsert(frame(spark, [("q", 1, 99)]), order="x", stream=("s", 1)) == store.version() == 2
    assert rows(store.read()) == [("p", 1, 12), ("q", 1, 6)]


def test_rows_are_added_once_and_purged_on_demand(spark, store):
    store.add(frame(spark, [("p", 1, 10), ("p", None, 11), ("q", 1, 12)]))
    for again in ([("r", 1, 1), ("p", None, 1)], [("r", 1, 1), ("r", 1, 2)]):
        with pytest.raises(ValueError, match="there already"):
            store.add(frame(spark, again))
    store.add(frame(spark, [("r", 1, 1)]))
    for wrong in (lambda: store.purge("a", "p"), lambda: store.purge("a", "z", confirm=True)):
        with pytest.raises(ValueError):
            wrong()
    assert store.read().count() == 4
    store.purge("a", "p", confirm=True)
    assert rows(store.read()) == [("q", 1, 12), ("r", 1, 1)]


def test_empty_tables(spark, store):
    store.replace(frame(spark, []))
    assert store.read().columns == ["a", "b", "x"] and store.read().count() == 0
    store.upsert(frame(spark, []))
    store.upsert(frame(spark, [("p", 1, 1)]))
    store.delete(frame(spark, [("p", 1, 1)]))
    assert store.read().count() == 0


def record(quality="good", time="2024-05-01T10:00:00", **more):
    return json.dumps({"timestamp": time, "quality_metrics": {"quality_status": quality, **more}})


FILES = [
    ("/d/1/s1_ses-01_task-rest_run-01_qc_metrics.json", record()),
    ("/d/2/s1_ses-01_task-rest_run-01_qc_metrics.json", record("poor", "2024-05-02T10:00:00")),
    ("/d/3/s2_ses-01_task-rest_run-01_qc_metrics.json", record("poor", "tomorrow", n_bad_channels=3)),
    ("/d/4/s3_ses-01_task-rest_run-01_qc_metrics.json", "{broken"),
    ("/d/5/s4_ses-01_task-rest_run-01_qc_metrics.json", "[]"),
    ("/d/6/s5_ses-01_task-rest_run-01_qc_metrics.json", '{"quality_metrics": "none"}'),
    ("/d/7/notes_qc_metrics.json", record()),
    ("/d/8/s6_ses-01_task-rest_run-01_qc_metrics.json", "{}"),
    ("/d/9/s7_ses-01_task-rest_run-01_qc_metrics.json", None),
]


def test_quality_records_are_imported_once(spark, tmp_path):
    store = StateTable(spark, f"file://{tmp_path}/states", st.RUN)
    files = spark.createDataFrame(FILES, "path string, content string")
    now = F.lit("2030-01-01").cast("timestamp")
    out = st.import_quality(store, files, "standard", now)
    assert {r["path"][:4]: (r["outcome"], r["problem"]) for r in out.collect()} == {
        "/d/1": ("imported", None), "/d/2": ("skipped", None), "/d/3": ("imported", None), "/d/4": ("failed", "content"), "/d/5": ("failed", "content"),
        "/d/6": ("failed", "metrics"), "/d/7": ("failed", "name"), "/d/8": ("imported", None), "/d/9": ("failed", "content")}
    assert tuple(st.outcome_counts(out).first()) == (3, 1, 5, 3)
    states = {r["subject_id"]: r for r in store.read().collect()}
    assert set(states) == {"s1", "s2", "s6"} and all(r["status"] == "completed" for r in states.values())
    assert states["s1"]["created_at"] == dt.datetime(2024, 5, 1, 10) and states["s2"]["created_at"] == dt.datetime(2030, 1, 1)
    step = states["s2"]["steps"][0]
    assert (step["step_name"], step["output_path"]) == ("preprocessing_run01", "/d/3")
    said = json.loads(step["metadata"])
    assert (said["n_bad_channels"], said["quality_status"], said["recommended_action"], json.loads(said["qc_metrics"])["n_bad_channels"]) == (3, "poor", "review", 3)

    version = store.version()
    again = st.import_quality(store, files, "standard", now)
    assert tuple(st.outcome_counts(again).first()) == (0, 4, 5, 0) and store.version() == version
    forced = st.import_quality(store, files, "standard", now, force=True)
    assert tuple(st.outcome_counts(forced).first()) == (4, 0, 5, 3)
    row = store.read().filter("subject_id = 's1'").first()
    assert row["created_at"] == dt.datetime(2024, 5, 1, 10) and json.loads(row["steps"][0]["metadata"])["quality_status"] == "poor"
    other = st.import_quality(store, files, "strict", now)
    assert st.outcome_counts(other).first()["imported"] == 3 and store.read().count() == 6


def test_an_import_that_dies_leaves_the_states(spark, tmp_path, monkeypatch):
    store = StateTable(spark, f"file://{tmp_path}/states", st.RUN)
    files = spark.createDataFrame(FILES, "path string, content string")
    with monkeypatch.context() as m:
        m.setattr(StateTable, "_publish", lambda self, said: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            st.import_quality(store, files, "standard")
    assert store.read() is None
    assert st.outcome_counts(st.import_quality(store, files, "standard")).first()["imported"] == 3


def test_records_of_a_folder_are_imported(spark, tmp_path):
    for path, content in FILES[:4]:
        folder = tmp_path / "q" / path.split("/")[2]
        folder.mkdir(parents=True)
        (folder / path.split("/")[-1]).write_text(content)
    (tmp_path / "q" / "other.json").write_text("{}")
    from neurospan.sources.listing import read_texts

    found = read_texts(spark, f"file://{tmp_path}/q", "*_qc_metrics.json")
    store = StateTable(spark, f"file://{tmp_path}/states", st.RUN)
    assert tuple(st.outcome_counts(st.import_quality(store, found, "p")).first()) == (2, 1, 1, 2)


def plain_states(records):
    last = {}
    for run, step, status, at, error in records:
        if None not in (run, step, at):
            new = (at, status is not None, status or "", error is not None, error or "")
            if new > last.get((run, step), ((dt.datetime.min,),))[0]:
                last[run, step] = (new, status, error)
    out = {}
    for (run, step), (new, status, error) in last.items():
        out.setdefault(run, []).append((new[0], step, status, error))
    made = []
    for run, steps in out.items():
        steps.sort(key=lambda s: s[:2])
        failed = [s for s in steps if s[2] == "failed"]
        going = any(s[2] in ("in_progress", "pending") for s in steps)
        made.append((run, len(steps), [s[1] for s in steps if s[2] == "completed"], [s[1] for s in failed], "failed" if failed else "in_progress" if going else "completed", failed[-1][3] if failed else None, max(s[0] for s in steps)))
    return sorted(made, key=repr)


def step_records(rng, n, start=0):
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=start + rng.randrange(600))
    return [(f"r{rng.randrange(8)}", rng.choice(["load", "filter", "ica", "epochs"]), rng.choice(["completed", "failed", "in_progress", "skipped", None]), at(), rng.choice([None, "e1", "e2"])) for _ in range(n)]


def test_run_states_of_a_table(spark):
    records = [*step_records(random.Random(1), 200), (None, "load", "failed", dt.datetime(2024, 1, 1), None), ("r1", None, "failed", dt.datetime(2024, 1, 1), None), ("r1", "load", "failed", None, None)]
    assert rows(runs.run_states(spark.createDataFrame(records, runs.RECORD))) == plain_states(records)
    assert runs.run_states(spark.createDataFrame([], runs.RECORD)).count() == 0


def arrive(folder, name, records):
    lines = [json.dumps({"run_id": r, "step_name": s, "status": t, "at": at.isoformat() if at else None, "error": e}) for r, s, t, at, e in records]
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(lines))


def test_the_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rng = random.Random(2)
    batches = [step_records(rng, 60, 300 * i) for i in range(3)]
    table = StateTable(spark, f"file://{tmp_path}/runs", ["run_id"])
    for i, batch in enumerate(batches):  # the query stops and starts again between the batches
        arrive(tmp_path / "in", f"b{i}", batch)
        runs.follow(runs.read_records(spark, f"file://{tmp_path}/in", 1), table, f"file://{tmp_path}/checkpoint", "2 hours").awaitTermination()
        seen = [r for b in batches[: i + 1] for r in b]
        assert rows(table.read()) == plain_states(seen) == rows(runs.run_states(spark.createDataFrame(seen, runs.RECORD)))


def test_late_records_are_dropped(spark, tmp_path):
    noon = dt.datetime(2024, 1, 1, 12)
    minute = dt.timedelta(minutes=1)
    batches = [[("a", "load", "completed", noon, None)], [("a", "filter", "completed", noon - 5 * minute, None), ("a", "ica", "failed", noon - 60 * minute, "late"), ("b", "load", "failed", noon - 30 * minute, "late")], [("a", "epochs", "failed", noon + minute, "x")]]
    table = StateTable(spark, f"file://{tmp_path}/runs", ["run_id"])
    for i, batch in enumerate(batches):
        arrive(tmp_path / "in", f"b{i}", batch)
        runs.follow(runs.read_records(spark, f"file://{tmp_path}/in", 1), table, f"file://{tmp_path}/checkpoint", "10 minutes").awaitTermination()
    assert rows(table.read()) == [("a", 3, ["filter", "load"], ["epochs"], "failed", "x", noon + minute)]
