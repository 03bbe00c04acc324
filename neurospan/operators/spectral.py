"""Signal kernels as grouped maps: one group is one recording (or window of one), never the whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from neurospan.functions import kernels as kn

EDGES = "rec_id long, method string, roi_i int, roi_j int, weight double, error string"


def _array(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame.sort_values("sample_idx")["values"].to_numpy()).T.astype(float)


def edges(recordings: DataFrame, metrics: Callable[[np.ndarray], dict[str, np.ndarray]], directed: bool = False) -> DataFrame:
    """rec_id, method, roi_i, roi_j, weight from matrices of each recording (rec_id, sample_idx, values).

    A recording on which the kernel fails gives one row with the error instead of failing the job.
    """
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            found = metrics(_array(frame))
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([(key[0], None, None, None, None, str(e))], columns=["rec_id", "method", "roi_i", "roi_j", "weight", "error"])
        parts = []
        for name, m in found.items():
            i, j = np.triu_indices(len(m), 1) if not directed else np.nonzero(~np.eye(len(m), dtype=bool))
            parts.append(pd.DataFrame({"rec_id": key[0], "method": name, "roi_i": i, "roi_j": j, "weight": m[i, j], "error": None}))
        return pd.concat(parts)

    return recordings.select("rec_id", "sample_idx", "values").groupBy("rec_id").applyInPandas(run, EDGES)


def phase_edges(recordings: DataFrame, lo: float, hi: float, sfreq: float) -> DataFrame:
    """The analytic signal is made once for a recording; all phase measures follow from it."""
    return edges(recordings, lambda x: kn.phase_metrics(kn.band_analytic(x, lo, hi, sfreq)))


def envelope_edges(recordings: DataFrame, lo: float, hi: float, sfreq: float) -> DataFrame:
    return edges(recordings, lambda x: kn.envelope_metrics(kn.band_analytic(x, lo, hi, sfreq)))


def coherence_edges(recordings: DataFrame, lo: float, hi: float, sfreq: float, segment: int = 256) -> DataFrame:
    return edges(recordings, lambda x: kn.coherence_metrics(x, lo, hi, sfreq, segment))


def partial_edges(recordings: DataFrame) -> DataFrame:
    return edges(recordings, lambda x: {"partial": kn.partial_correlation(x)})


def directed_edges(recordings: DataFrame, lo: float, hi: float, sfreq: float, order: int = 10) -> DataFrame:
    return edges(recordings, lambda x: kn.directed_metrics(kn.fit_mvar(x, order), lo, hi, sfreq), directed=True)


def power(recordings: DataFrame, freqs: list[float], sfreq: float, step: int = 1, cycles: float = 7.0) -> DataFrame:
    """rec_id, channel, freq, t, power of Morlet wavelets, every step-th sample."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        p = kn.morlet_power(_array(frame), np.array(freqs), sfreq, cycles)[:, :, ::step]
        c, f, t = np.indices(p.shape)
        return pd.DataFrame({"rec_id": key[0], "channel": c.ravel(), "freq": np.array(freqs)[f.ravel()], "t": t.ravel() * step, "power": p.ravel()})

    return recordings.select("rec_id", "sample_idx", "values").groupBy("rec_id").applyInPandas(run, "rec_id long, channel int, freq double, t int, power double")


def transform(recordings: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Recordings with another array of the same channels: filters, resampling."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        y = kernel(_array(frame))
        return pd.DataFrame({"rec_id": key[0], "sample_idx": np.arange(y.shape[1]), "values": list(y.T)})

    return recordings.select("rec_id", "sample_idx", "values").groupBy("rec_id").applyInPandas(run, "rec_id long, sample_idx long, values array<double>")


def channel_table(recordings: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v = kernel(_array(frame))
        return pd.DataFrame({"rec_id": key[0], "channel": np.arange(len(v)), name: v})

    return recordings.select("rec_id", "sample_idx", "values").groupBy("rec_id").applyInPandas(run, f"rec_id long, channel int, {name} double")


def quality(recordings: DataFrame) -> DataFrame:
    """rec_id, rank, feasible, n_components, bridged: what decides on a decomposition."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = _array(frame)
        rank, ok, n = kn.rank_and_components(x)
        return pd.DataFrame([(key[0], rank, ok, n, kn.bridged(kn.correlate(x)))], columns=["rec_id", "rank", "feasible", "n_components", "bridged"])

    return recordings.select("rec_id", "sample_idx", "values").groupBy("rec_id").applyInPandas(run, "rec_id long, rank int, feasible boolean, n_components int, bridged array<int>")


def components(recordings: DataFrame, n: int) -> DataFrame:
    """Independent components as recordings of n channels."""
    return transform(recordings, lambda x: kn.fast_ica(x, n)[1])
