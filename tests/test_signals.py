import math

import numpy as np
import pytest

from neurospan.functions import kernels as kn
from neurospan.operators import connectivity as cn
from neurospan.operators import epochs as ep
from neurospan.operators import spectral as sp
from neurospan.operators import windows as wi

SF = 250.0
T = np.arange(1000) / SF


def long(spark, x):
    return spark.createDataFrame([(0, c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)], "rec_id long, channel int, sample_idx long, value double")


def rows(spark, x):
    return spark.createDataFrame([(0, i, [float(v) for v in x[:, i]]) for i in range(x.shape[1])], "rec_id long, sample_idx long, values array<double>")


def test_islands_of_a_mask(spark):
    mask = spark.createDataFrame([(0, i) for i in (1, 2, 4)], "rec_id long, sample_idx long")
    out = sorted((r["onset"], r["duration"]) for r in wi.islands(mask, "rec_id", "sample_idx", 10.0, 0.1).collect())
    assert out == [(0.1, 0.2), (0.4, 0.1)]


def test_the_last_window_counts_for_hops_and_not_for_tumbling(spark):
    df = long(spark, np.concatenate([np.arange(16.0), np.zeros(4)])[None])
    args = ("rec_id", "channel", "sample_idx", "value", 4)
    assert not wi.flat_channels(df, *args, 1e-6).first()["flat"]
    assert wi.low_variance_hops(df, *args, 1e-12).first()["flat"]


def test_good_samples_leave_intervals_out(spark):
    df = long(spark, np.ones((1, 100)))
    bad = spark.createDataFrame([(0, 0.0, 2.0), (0, 1.0, 2.0)], "rec_id long, onset double, duration double")
    assert wi.good_samples(df, bad, "rec_id", "sample_idx", 10.0).count() == 70


def test_epochs_overlap_baseline_and_rejection(spark):
    x = np.stack([np.arange(100.0), np.zeros(100)])
    events = spark.createDataFrame([(0, 1, 20, "a"), (0, 2, 60, "b")], "rec_id long, epoch_id long, sample long, condition string")
    cut = ep.cut(long(spark, x), events, 5, 4)
    assert cut.count() == 40
    flat = ep.baseline(cut, -5, -1).filter("channel = 0 and t = 0").collect()
    assert {r["value"] for r in flat} == {3.0}
    assert abs(ep.detrend(cut).agg({"value": "max"}).first()[0]) < 1e-9
    out = ep.reject(cut, 8.0, None).collect()
    assert all(r["dropped"] and r["max_ptp"] == 9.0 and r["min_ptp"] == 0.0 for r in out)
    spans = spark.createDataFrame([(0, 1, 10, 20), (0, 2, 20, 30)], "rec_id long, epoch_id long, start long, stop long")
    bad = spark.createDataFrame([(0, 5, 11), (0, 40, 50)], "rec_id long, lo long, hi long")
    assert [r["epoch_id"] for r in ep.overlap_anti_join(spans, bad, 8).collect()] == [2]


def test_moment_matrices_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(5, 200))
    x[4] = 1.0
    out = {(r["roi_i"], r["roi_j"]): r["weight"] for r in cn.correlation_edges(rows(spark, x), "rec_id").collect()}
    want = np.corrcoef(x[:4])
    assert all(abs(out[i, j] - want[i, j]) < 1e-9 for i in range(4) for j in range(i + 1, 4))
    assert out[0, 4] is None


def test_phase_measures_of_known_lags():
    x = np.stack([np.sin(2 * np.pi * 10 * T), np.sin(2 * np.pi * 10 * T - np.pi / 2), np.sin(2 * np.pi * 10 * T)])
    m = kn.phase_metrics(kn.band_analytic(x, 8, 12, SF)[:, 200:800])
    assert m["plv"][0, 1] > 0.999 and m["plv"][0, 2] > 0.999
    assert m["pli"][0, 1] > 0.999 and m["pli"][0, 2] < 0.6
    assert m["wpli"][0, 1] > 0.999 and m["dwpli"][0, 1] > 0.99


def test_sql_and_matrix_phase_measures_agree(spark):
    z = kn.band_analytic(np.random.default_rng(1).normal(size=(3, 300)), 8, 12, SF)
    df = spark.createDataFrame([(0, i, c, float(z[c, i].real), float(z[c, i].imag)) for c in range(3) for i in range(300)], "rec_id long, idx long, roi int, re double, im double")
    m = kn.phase_metrics(z)
    for r in cn.phase_edges(df, "rec_id").collect():
        for k in m:
            assert abs(r[k] - m[k][r["roi_i"], r["roi_j"]]) < 1e-9, k


def test_bandpass_keeps_the_band_and_removes_the_rest():
    b, a = kn.butter_bandpass(4, 8, 13, SF)
    assert len(b) == len(a) == 9
    freq = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / SF)) / np.polyval(a, np.exp(2j * np.pi * f / SF)))
    assert abs(freq(8) - 1 / math.sqrt(2)) < 1e-6 and abs(freq(13) - 1 / math.sqrt(2)) < 1e-6 and freq(10.2) > 0.999 and freq(30) < 1e-2
    y = kn.zero_phase(b, a, np.sin(2 * np.pi * 10 * T)[None])
    assert np.abs(y[0, 200:800] - np.sin(2 * np.pi * 10 * T)[200:800]).max() < 0.01
    with pytest.raises(ValueError):
        kn.zero_phase(b, a, np.zeros((1, 20)))


def test_spectra_and_coherence():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 20_000))
    x[1] = x[0]
    m = kn.coherence_metrics(x, 8, 13, SF)
    assert abs(m["coherence"][0, 1] - 1) < 1e-9 and m["coherence"][0, 2] < 0.1 and m["icoh"][0, 1] < 1e-9
    freqs, csd = kn.cross_spectra(x[:1], SF)
    assert abs(np.real(csd[:, 0, 0]).sum() * (freqs[1] - freqs[0]) - 1) < 0.05  # the power is the variance
    line = x[:1] + 5 * np.sin(2 * np.pi * 50 * np.arange(20_000) / SF)
    assert kn.line_noise_ratio(line, SF)[0] > 20 and kn.line_noise_ratio(x[:1], SF)[0] < 1.5


def test_autoregression_finds_the_direction():
    rng = np.random.default_rng(5)
    x = np.zeros((2, 5000))
    for t in range(1, 5000):
        x[0, t] = 0.5 * x[0, t - 1] + rng.normal()
        x[1, t] = 0.6 * x[0, t - 1] + 0.2 * x[1, t - 1] + rng.normal()
    a = kn.fit_mvar(x, 2)
    assert np.abs(a[0] - [[0.5, 0], [0.6, 0.2]]).max() < 0.06
    m = kn.directed_metrics(a, 5, 40, SF)
    assert m["pdc"][0, 1] > 5 * m["pdc"][1, 0] and m["dtf"][0, 1] > 5 * m["dtf"][1, 0]


def test_other_kernels():
    rng = np.random.default_rng(6)
    tone = np.sin(2 * np.pi * 10 * T)[None]
    p = kn.morlet_power(tone, np.array([5.0, 10.0, 20.0]), SF)[0, :, 400:600].mean(1)
    assert p.argmax() == 1 and p[1] > 20 * max(p[0], p[2])
    low = kn.apply_fir(kn.fir(None, 20.0, SF, 201), tone + np.sin(2 * np.pi * 60 * T))
    assert np.abs(low - tone)[0, 150:850].max() < 0.02
    assert np.abs(kn.resample(tone, SF, 125.0)[0, 50:450] - tone[0, 100:900:2]).max() < 1e-2
    assert kn.resample(tone, SF, SF) is tone
    x = rng.normal(size=(3, 500))
    x[2] = x[0] + x[1] + 0.1 * x[2]
    partial = kn.partial_correlation(x)
    r = np.corrcoef(x)
    want = (r[0, 1] - r[0, 2] * r[1, 2]) / math.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2))
    assert abs(partial[0, 1] - want) < 1e-9
    s = np.stack([np.sign(np.sin(2 * np.pi * 3 * T)), rng.uniform(-1, 1, 1000)])
    found = kn.fast_ica(np.array([[1, 0.5], [0.4, 1]]) @ s, 2)[1]
    assert sorted(np.abs(np.corrcoef(np.concatenate([s, found]))[:2, 2:]).max(1))[0] > 0.95
    ring = np.roll(np.eye(5), 1, 0) + np.roll(np.eye(5), -1, 0) > 0
    assert kn.path_length(ring) == 1.5 and kn.path_length(np.zeros((3, 3), bool)) is None
    assert kn.bridged(np.ones((12, 12)), keep=10) == [0, 1]


def test_a_failing_recording_is_a_row(spark):
    out = sp.phase_edges(rows(spark, np.zeros((2, 10))), 8, 13, SF).collect()
    assert len(out) == 1 and "too few" in out[0]["error"]
