"""Registered queries read whole tables: no subset of ids, no prefix of texts or channels."""

import html

import numpy as np
import pytest

from neurospan.plans import model_queries, record_queries, spectral_queries


@pytest.mark.parametrize("name", ["bids_parse", "legacy_task_parse", "format_priority", "runs_by_task", "subject_task_matrix", "distinct_levels"])
def test_listings_parse_every_order(spark, tmp_path, name):
    rows = [(k, k % 7) for k in (1, 2999, 3000, 3001, 40_003, 1_000_001)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    out = [r.asDict() for r in model_queries.QUERIES[name](spark, str(tmp_path)).collect()]
    if name in ("bids_parse", "legacy_task_parse"):
        assert sorted(r["o_orderkey"] for r in out) == [k for k, _ in rows]
    elif name == "format_priority":
        assert any(r["o_orderkey"] > 3000 for r in out)
    elif name == "runs_by_task":
        assert len(out) == len(rows)
    elif name == "subject_task_matrix":
        assert {r["subject"] for r in out} == {str(c) for _, c in rows}
    else:
        assert out[0]["n_files"] == len(rows)


def test_whole_pages_are_escaped(spark, tmp_path):
    pages = [(1, "<b class='x'>&\"</b>" * 50), (2, None), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r["page_id"]: r["html"] for r in record_queries.escaped_names(spark, str(tmp_path)).collect()}
    assert out == {i: None if t is None else html.escape(t).replace("&#x27;", "&#39;") for i, t in pages}


def test_signal_kernels_take_every_channel(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(250, 20))
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: spectral_queries.QUERIES[name](spark, str(tmp_path)).collect()
    every = set(range(20))
    for name in ("phase_edges", "envelope_edges", "coherence_edges", "partial_corr_edges"):
        pairs = {(r["roi_i"], r["roi_j"]) for r in run(name)}
        assert pairs == {(i, j) for i in every for j in every if i < j}
    for name in ("morlet_power", "band_power"):
        assert {r["channel"] for r in run(name)} == every
    for name in ("fir_filtered", "resampled"):
        assert {len(r["values"]) for r in run(name)} == {20}
    inverse = np.linalg.inv(np.corrcoef(x.T))
    scale = np.sqrt(np.diag(inverse))
    want = -inverse / np.outer(scale, scale)
    assert all(abs(r["weight"] - want[r["roi_i"], r["roi_j"]]) < 1e-3 for r in run("partial_corr_edges"))
    mixed = {r["sample_idx"]: r["values"] for r in run("ica_sources")}
    sources = np.array([mixed[i] for i in range(250)])
    centred = x - x.mean(0)
    left = sources - centred @ np.linalg.lstsq(centred, sources, rcond=None)[0]
    assert np.abs(left - left.mean(0)).max() < 1e-6  # a linear map of all channels
    few = sources - centred[:, :12] @ np.linalg.lstsq(centred[:, :12], sources, rcond=None)[0]
    assert np.abs(few - few.mean(0)).max() > 1e-3
