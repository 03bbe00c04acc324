"""Analytic samples by filters in quadrature, and the phase measures that rest on them."""

import numpy as np

from neurospan.functions import kernels
from neurospan.operators import connectivity as cn
from neurospan.operators import windows as wi


def test_the_pair_gives_amplitude_and_phase(spark):
    t = np.arange(600) / 250
    x = 3 * np.cos(2 * np.pi * 19 * t + 0.7) + 5 * np.cos(2 * np.pi * 60 * t)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "rec long, channel int, idx long, value double")
    pair = [p.tolist() for p in kernels.quadrature(8.0, 30.0, 250.0, 129)]
    z = sorted((r["idx"], complex(r["re"], r["im"])) for r in wi.analytic(df, "rec", "channel", "idx", "value", pair, 50).collect())
    inner = np.array([v for i, v in z if 70 <= i < 530])
    want = 3 * np.exp(1j * (2 * np.pi * 19 * t + 0.7))[70:530]
    assert np.abs(inner - want).max() < 0.05


def test_phase_measures_are_the_kernels(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4, 300))
    x[1] = x[0] + 0.3 * rng.normal(size=300)
    x[3] = np.roll(x[2], 4)
    pair = kernels.quadrature(8.0, 30.0, 250.0, 65)
    z = kernels.apply_fir(pair[0], x) + 1j * kernels.apply_fir(pair[1], x)
    rows = [(1, c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)]
    long = wi.analytic(spark.createDataFrame(rows, "rec long, roi int, idx long, value double").repartition(3), "rec", "roi", "idx", "value", [p.tolist() for p in pair], 64)
    want = kernels.phase_metrics(z)
    size = np.abs(z)
    for r in cn.phase_edges(long, "rec").collect():
        i, j = r["roi_i"], r["roi_j"]
        assert abs(r["plv"] - want["plv"][i, j]) < 1e-9 and abs(r["wpli"] - want["wpli"][i, j]) < 1e-9 and abs(r["dwpli"] - want["dwpli"][i, j]) < 1e-9
        assert abs(r["pli"] - want["pli"][i, j]) <= 2.5 / 300  # signs of rounding errors
        assert abs(r["aec"] - np.corrcoef(size[i], size[j])[0, 1]) < 1e-9
    assert want["plv"][0, 1] > 0.8 and want["wpli"][2, 3] > 0.5
