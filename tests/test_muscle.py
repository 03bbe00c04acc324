"""Convolution over chunks of time, and the muscle mask that rests on it."""

import numpy as np
import pytest

from neurospan.functions import kernels
from neurospan.operators import windows as wi


def long(spark, recordings):
    rows = [(rec, c, i, float(v)) for rec, x in recordings.items() for c, row in enumerate(x) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "rec long, channel int, idx long, value double").repartition(5)


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(3)
    out = {1: rng.normal(size=(2, 257)), 2: rng.normal(size=(3, 100)), 3: rng.normal(size=(2, 17))}
    t = np.arange(80) / 500
    out[1][:, 100:180] += 6 * np.sin(2 * np.pi * 125 * t)
    return out


@pytest.mark.parametrize("chunk", [7, 16, 100, 4096])
def test_any_chunk_gives_the_whole_convolution(spark, recordings, chunk):
    taps = kernels.fir(110.0, 140.0, 500.0, 33)
    taps = taps + np.linspace(0, 0.01, len(taps))  # not symmetric: directions count
    got = {(r["rec"], r["channel"], r["idx"]): r["value"] for r in wi.convolved(long(spark, recordings), "rec", "channel", "idx", "value", taps.tolist(), chunk).collect()}
    want = {(rec, c, i): v for rec, x in recordings.items() for c, row in enumerate(kernels.apply_fir(taps, x)) for i, v in enumerate(row)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_recordings_and_missing_values_are_null(spark):
    x = {1: np.arange(10.0).reshape(1, -1), 2: np.arange(3.0).reshape(1, -1)}
    df = long(spark, x).selectExpr("rec", "channel", "idx", "nullif(value, 7.0) AS value")
    out = {(r["rec"], r["idx"]): r["value"] for r in wi.convolved(df, "rec", "channel", "idx", "value", [0.25, 0.5, 0.25], 4).collect()}
    assert out == {(1, 0): 0.5, **{(1, i): float(i) for i in range(1, 6)}, (1, 6): None, (1, 7): None, (1, 8): None, (1, 9): 8.5, (2, 0): 0.5, (2, 1): 1.0, (2, 2): 1.5}
    assert wi.convolved(df, "rec", "channel", "idx", "value", [0.1] * 9, 4).filter("rec = 2").count() == 0


def test_the_burst_is_marked_and_the_plan_holds_no_recording(spark, recordings):
    taps = kernels.fir(110.0, 140.0, 500.0, 61).tolist()
    x = {1: recordings[1]}
    mask = wi.muscle_mask(long(spark, x), "rec", "channel", "idx", "value", taps, 1.0, 32)
    power = np.abs(kernels.apply_fir(np.array(taps), recordings[1])).mean(0)
    want = np.flatnonzero((power - power.mean()) / power.std() > 1.0)
    assert sorted(r["idx"] for r in mask.collect()) == want.tolist() and want.min() > 80 and want.max() < 200
    marks = wi.annotations(long(spark, x), "rec", "channel", "idx", "value", 500.0, 20, muscle=1.0, taps=taps)
    assert {r["description"] for r in marks.collect()} == {"BAD_muscle"}
    plan = mask._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "Python" not in plan
