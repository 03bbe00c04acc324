"""Welch spectra from sums agree with those of arrays."""

import numpy as np

from neurospan.functions import kernels
from neurospan.operators import spectra as se

SFREQ, SIZE = 200.0, 64


def test_spectra_are_those_of_arrays(spark):
    rng = np.random.default_rng(9)
    t = np.arange(230) / SFREQ
    x = rng.normal(size=(4, 230)) + 3 + np.sin(2 * np.pi * 50 * t)
    x[3] = np.roll(x[0], 3)
    rows = [(1, c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)]
    df = spark.createDataFrame(rows, "rec int, ch int, idx long, value double").repartition(4)
    z = se.transformed(df, "rec", "ch", "idx", "value", SIZE, 0, SIZE // 2).cache()
    freqs, csd = kernels.cross_spectra(x, SFREQ, SIZE)
    psd = se.density(z, ["rec", "ch"], SIZE, SFREQ)
    got = {(r["ch"], r["bin"]): (r["frequency"], r["psd"]) for r in psd.collect()}
    assert len(got) == 4 * 33
    for (c, b), (f, p) in got.items():
        assert abs(f - freqs[b]) < 1e-9 and abs(p - csd[b, c, c].real) < 1e-9
    ratio = {r["ch"]: r["ratio"] for r in se.line_ratio(psd, ["rec", "ch"]).collect()}
    away = np.abs(freqs - 50)
    for c, v in ratio.items():
        p = csd[:, c, c].real
        assert v > 3 and abs(v - p[away <= 2].mean() / p[(away > 2) & (away <= 10)].mean()) < 1e-9
    first, last = se.bins(SIZE, SFREQ, 8.0, 30.0)
    want = kernels.coherence_metrics(x, 8.0, 30.0, SFREQ, SIZE)
    for r in se.coherence(z.filter(f"bin BETWEEN {first} AND {last}"), "rec", "ch").collect():
        i, j = r["roi_i"], r["roi_j"]
        assert abs(r["coherence"] - want["coherence"][i, j]) < 1e-9 and abs(r["icoh"] - want["icoh"][i, j]) < 1e-9
    power = se.band_power(psd, ["ch"], {"alpha": (8.0, 13.0)}).collect()
    inside = (freqs >= 8) & (freqs < 13)
    assert all(abs(r["alpha"] - csd[inside, r["ch"], r["ch"]].real.mean()) < 1e-9 for r in power)
    z.unpersist()


def test_segments_with_missing_values_and_short_recordings_have_none(spark):
    rows = [(1, 0, i, None if i == 10 else float(i % 5)) for i in range(24)] + [(2, 0, i, 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "rec int, ch int, idx long, value double")
    z = se.transformed(df, "rec", "ch", "idx", "value", 8, 0, 4)
    assert sorted({(r["rec"], r["wstart"]) for r in z.collect()}) == [(1, 0), (1, 12), (1, 16)]
    flat = spark.createDataFrame([(1, c, i, 2.0 * c) for c in range(2) for i in range(16)], "rec int, ch int, idx long, value double")
    row = se.coherence(se.transformed(flat, "rec", "ch", "idx", "value", 8, 1, 3), "rec", "ch").first()
    assert row["coherence"] is not None and row["roi_i"] == 0


def test_wavelets_are_those_of_arrays(spark):
    x = np.random.default_rng(10).normal(size=(2, 150))
    rows = [(1, c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)]
    df = spark.createDataFrame(rows, "rec int, ch int, idx long, value double").repartition(3)
    want = kernels.morlet_power(x, np.array([20.0, 35.0]), SFREQ, 5.0)
    for chunk in (40, 4096):
        out = se.wavelet_power(df, "rec", "ch", "idx", "value", [20.0, 35.0], SFREQ, 5.0, chunk).collect()
        assert len(out) == 2 * 150 * 2
        assert all(abs(r["power"] - want[r["ch"], [20.0, 35.0].index(r["frequency"]), r["idx"]]) < 1e-9 for r in out)
