import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from neurospan.operators import learning, source_space, steps
from neurospan.sources import config, edf
from neurospan.streaming import windows as sw


def edf_bytes(signals, rate, wide=False):
    n, records = len(signals), len(signals[0]) // rate
    field = lambda v, w: str(v).ljust(w).encode("latin-1")[:w]
    head = (b"\xffBIOSEMI" if wide else field("0", 8)) + field("X", 80) + field("X", 80) + field("01.01.20", 8) + field("00.00.00", 8) + field(256 * (n + 1), 8) + field("", 44) + field(records, 8) + field(1, 8) + field(n, 4)
    top = (1 << 23) - 1 if wide else 32767
    rows = [("C%d", 16), ("", 80), ("uV", 8), (-100, 8), (100, 8), (-top - 1, 8), (top, 8), ("", 80), (rate, 8), ("", 32)]
    for value, width in rows:
        for i in range(n):
            head += field(value % i if value == "C%d" else value, width)
    body = b""
    for k in range(records):
        for s in signals:
            digital = np.round((s[k * rate : (k + 1) * rate] + 100) / 200 * (2 * top + 1) - top - 1).astype(np.int64)
            body += b"".join(int(d).to_bytes(3, "little", signed=True) for d in digital) if wide else digital.astype("<i2").tobytes()
    return head + body


@pytest.mark.parametrize("wide", [False, True])
def test_recordings_round_trip(spark, tmp_path, wide):
    x = [50 * np.sin(np.arange(500) / 9), np.linspace(-90, 90, 500)]
    name = "a.bdf" if wide else "a.edf"
    (tmp_path / name).write_bytes(edf_bytes(x, 100, wide))
    (tmp_path / "broken.edf").write_bytes(b"0" * 300)
    out = {(r["path"].rsplit("/")[-1], r["channel"]): r for r in edf.read_recordings(spark, f"file://{tmp_path}").collect()}
    for i in range(2):
        r = out[name, f"C{i}"]
        assert r["sfreq"] == 100 and r["unit"] == "uV" and np.abs(np.array(r["values"]) - x[i]).max() < 0.01
    assert out["broken.edf", None]["error"]


def test_task_config(spark):
    task = config.TaskConfig.from_yaml("""
task_name: t
conditions:
  - {name: left, event_codes: [1, a]}
  - {name: right, event_codes: [2, 1]}
erp_components: [{name: P3, tmin: 0.3, tmax: 0.5}]
""")
    assert task.event_codes() == ["1", "a", "2", "1"] and task.erp_components[0].tmax == 0.5
    assert task.condition_table(spark).count() == 2
    assert config.translate_codes(["x", 3, "y"], {"x": "7"}) == ["7", "3", "y"]
    assert config.config_hash({"a": 1, "b": {"c": 2}}) == config.config_hash({"b": {"c": 2}, "a": 1}) != config.config_hash({"a": 2})
    from neurospan.operators.state import config_diff

    diff = config_diff(config.config_table(spark, {"a": 1, "b": {"c": 2, "d": 3}}), config.config_table(spark, {"a": 1, "b": {"c": 5}}), ["path"], "value")
    assert sorted((r["path"], r["a"], r["b"]) for r in diff.collect()) == [("b.c", "2", "5"), ("b.d", "3", None)]


def recs(spark, x):
    return spark.createDataFrame([(0, i, [float(v) for v in x[:, i]]) for i in range(x.shape[1])], "rec_id long, sample_idx long, values array<double>")


def array(df):
    return np.array([r["values"] for r in df.orderBy("sample_idx").collect()], float).T


def test_steps_chain_and_refuse_unknown_names(spark):
    t = np.arange(1000) / 250
    x = np.stack([np.sin(2 * np.pi * 10 * t) + 2, np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 50 * t), np.zeros(1000)])
    df = recs(spark, x)
    y = array(steps.run(df, [{"name": "notch", "params": {"sfreq": 250.0}}]))
    assert np.abs(y[1, 200:800] - x[0, 200:800] + 2).max() < 0.05
    ref = array(steps.run(df, [{"name": "reference", "params": {"channels": [0]}}]))
    assert np.abs(ref[0]).max() < 1e-12 and np.allclose(ref[1], x[1] - x[0])
    flat = steps.run(df, [{"name": "drop_flat"}]).first()["values"]
    assert flat[2] is None and flat[0] is not None
    fixed = array(steps.run(df, [{"name": "interpolate", "params": {"bads": [2], "positions": [[0, 0], [2, 0], [1, 0]]}}]))
    assert np.allclose(fixed[2], (x[0] + x[1]) / 2)
    assert array(steps.run(df, [{"name": "interpolate", "params": {"bads": [1, 2], "positions": [[0, 0], [2, 0], [1, 0]]}}])).shape == (1, 1000)
    assert array(steps.run(df, [{"name": "decimate", "params": {"factor": 10}}])).shape == (3, 100)
    with pytest.raises(ValueError):
        steps.run(df, [{"name": "nothing"}])


def test_regions_take_sources_by_place_or_by_distance(spark):
    src = spark.createDataFrame([(0, r, float(r)) for r in range(4)], "k int, row int, value double")
    out = {r["roi"]: r["value"] for r in source_space.extract_regions(src, ["k"], 6, 4).collect()}
    assert out == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 0.0, 5: 1.0}
    pos = spark.createDataFrame([(r, float(r), 0.0, 0.0) for r in range(4)], "row int, x double, y double, z double")
    atlas = spark.createDataFrame([(0, 0.5, 0.0, 0.0)], "roi int, x double, y double, z double")
    assert source_space.average_regions(src, pos, atlas, ["k"], 1.0).first()["value"] == 0.5


def test_models_fit_what_is_planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    rows = [([float(v) for v in r], float(3 * r[1] - r[3]), float(r[1] > 0)) for r in x]
    df = spark.createDataFrame(rows, "x array<double>, y double, c double").withColumn("features", array_to_vector("x"))
    fit = learning.pipeline("linear", "y", select=2).fit(df)
    err = fit.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert err < 1e-6
    assert learning.pipeline("svm", "c", select=1).fit(df).transform(df).filter("prediction = c").count() > 190
    best = learning.grid_search(df, "ridge", "y", folds=3, grid={"regParam": [0.001, 10.0]})
    assert best.avgMetrics[0] > best.avgMetrics[1]
    with pytest.raises(ValueError):
        learning.model("rbf")


def test_streams_equal_batches(spark, tmp_path):
    ev = spark.sql("select timestamp_seconds(1700000000 + id * 700) ts, id % 3 as k, cast(id as double) v from range(200)")
    ev.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"file://{tmp_path}/in")
    query = sw.window_stats(stream, "ts", "k", "v", "2 hours", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = sw.window_stats(ev, "ts", "k", "v", "2 hours", "1 hour")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    assert sw.sessions(ev, "ts", "k", "1 hour").count() == 3
