"""Named preprocessing steps on recordings (rec_id, sample_idx, values), chained from a configuration."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.functions import kernels as kn
from neurospan.operators import spectral as sp

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        if name in STEPS:
            raise ValueError(f"there is a step {name} already")
        STEPS[name] = f
        return f
    return add


@step("filter")
def bandpass(df: DataFrame, sfreq: float, l_freq: float | None = None, h_freq: float | None = None, taps: int = 101) -> DataFrame:
    h = kn.fir(l_freq, h_freq, sfreq, taps)
    return sp.transform(df, lambda x: kn.apply_fir(h, x))


@step("notch")
def notch(df: DataFrame, sfreq: float, freq: float = 50.0, width: float = 2.0, taps: int = 201) -> DataFrame:
    band = kn.fir(freq - width, freq + width, sfreq, taps)
    h = -band
    h[len(h) // 2] += 1
    return sp.transform(df, lambda x: kn.apply_fir(h, x))


@step("resample")
def resample(df: DataFrame, sfreq: float, new_sfreq: float) -> DataFrame:
    return df if sfreq == new_sfreq else sp.transform(df, lambda x: kn.resample(x, sfreq, new_sfreq))


@step("reference")
def reference(df: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Subtracts the mean of the reference channels, all by default: an expression on each sample's array."""
    picked = F.col("values") if channels is None else F.array(*[F.element_at("values", c + 1) for c in channels])
    mean = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.size(picked)
    return df.withColumn("values", F.transform("values", lambda x: x - mean))


@step("pick")
def pick(df: DataFrame, channels: list[int]) -> DataFrame:
    return df.withColumn("values", F.array(*[F.element_at("values", c + 1) for c in channels]))


@step("drop_flat")
def drop_flat(df: DataFrame, threshold: float = 1e-15) -> DataFrame:
    """Channels that are flat in a recording become null there, so arrays keep their positions."""
    long = df.select("rec_id", F.posexplode("values").alias("c", "x")).groupBy("rec_id", "c").agg(F.var_pop("x").alias("v"))
    flat = long.groupBy("rec_id").agg(F.collect_set(F.when(F.col("v") < threshold, F.col("c"))).alias("_flat"))
    keep = F.transform("values", lambda x, i: F.when(~F.array_contains("_flat", i), x))
    return df.join(flat, "rec_id").withColumn("values", keep).drop("_flat")


@step("decimate")
def decimate(df: DataFrame, factor: int) -> DataFrame:
    return df.filter(F.col("sample_idx") % factor == 0).withColumn("sample_idx", F.floor(F.col("sample_idx") / factor))


@step("interpolate")
def interpolate(df: DataFrame, bads: list[int], positions: list[list[float]], max_share: float = 0.5) -> DataFrame:
    """Bad channels from the others, weighted by inverse squared distance; dropped where more than max_share are bad."""
    n = len(positions)
    good = [c for c in range(n) if c not in bads]
    if len(bads) > max_share * n:
        return pick(df, good)
    p = np.array(positions, float)
    out = []
    for c in range(n):
        if c not in bads:
            out.append(F.element_at("values", c + 1))
            continue
        w = 1 / np.maximum(((p[good] - p[c]) ** 2).sum(1), 1e-12)
        out.append(sum((F.element_at("values", g + 1) * float(v) for g, v in zip(good, w / w.sum(), strict=True)), F.lit(0.0)))
    return df.withColumn("values", F.array(*out))


@step("ica")
def ica(df: DataFrame, n_components: int, drop: list[int] = ()) -> DataFrame:
    """Removes the listed components of each recording."""
    def clean(x: np.ndarray) -> np.ndarray:
        unmix, s = kn.fast_ica(x, n_components)
        s[list(drop)] = 0
        return np.linalg.pinv(unmix) @ s + x.mean(1, keepdims=True)
    return sp.transform(df, clean)


def run(df: DataFrame, config: list[dict[str, Any]]) -> DataFrame:
    """Applies steps {name, params} in order; unknown names and parameters are errors before anything runs."""
    unknown = [s["name"] for s in config if s["name"] not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known are {sorted(STEPS)}")
    for s in config:
        df = df.transform(STEPS[s["name"]], **s.get("params", {}))
    return df
