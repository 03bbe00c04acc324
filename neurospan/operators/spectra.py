"""Welch spectra as sums over samples: segments, frequencies and pairs of channels are rows, not arrays of a recording."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.functions.kernels import wavelet
from neurospan.operators.windows import convolved_with, hop


def bins(size: int, sfreq: float, low: float, high: float) -> tuple[int, int]:
    """The first and the last frequency bin of a closed band, for segments of size samples."""
    return max(math.ceil(low * size / sfreq - 1e-9), 0), min(math.floor(high * size / sfreq + 1e-9), size // 2)


def transformed(df: DataFrame, rec: str, channel: str, idx: str, value: str, size: int, first: int, last: int, step: int | None = None) -> DataFrame:
    """rec, channel, wstart, bin, re, im: segments' Fourier coefficients in bins first to last, mean removed, Hann window.

    Segments of size samples start every step (half a size by default) and lie inside the recording. A sample is
    a row for each of its segments and bins, added up in its task before anything is shuffled; the mean's share
    follows from the window's own transform, which has bins 0 and 1 only. A segment with a missing value has no coefficients.
    """
    step = step or max(size - size // 2, 1)
    rows = hop(df.select(rec, channel, idx, value), rec, idx, size, step)
    n = F.col(idx) - F.col("wstart")
    window = 0.5 - 0.5 * F.cos(n * (2 * math.pi / size))
    turn = F.pmod(F.col("bin") * n, F.lit(size)) * (2 * math.pi / size)
    each = rows.withColumn("bin", F.explode(F.sequence(F.lit(first), F.lit(last))))
    sums = each.groupBy(rec, channel, "wstart", "bin").agg(
        F.sum(F.col(value) * window * F.cos(turn)).alias("_c"), F.sum(F.col(value) * window * F.sin(turn)).alias("_s"), F.avg(value).alias("_m"), F.count(value).alias("_n"))
    own = F.when(F.col("bin") == 0, size / 2).when(F.col("bin") == 1, -size / 4).otherwise(0.0)
    return sums.filter(F.col("_n") == size).select(rec, channel, "wstart", "bin", (F.col("_c") - F.col("_m") * own).alias("re"), (-F.col("_s")).alias("im"))


def _scale(size: int, sfreq: float) -> Column:
    """What turns mean squares into densities: twice for bins that have a mirror image."""
    twice = F.when((F.col("bin") == 0) | (2 * F.col("bin") == size), 1.0).otherwise(2.0)
    return twice / (sfreq * 0.375 * size)


def density(spectra: DataFrame, keys: list[str], size: int, sfreq: float) -> DataFrame:
    """keys, bin, frequency, psd: power spectral density, the mean over segments."""
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    out = spectra.groupBy(*keys, "bin").agg(power.alias("_p"))
    return out.select(*keys, "bin", (F.col("bin") * (sfreq / size)).alias("frequency"), (F.col("_p") * _scale(size, sfreq)).alias("psd"))


def band_power(psd: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """keys and a column for each band: the mean density of frequencies from low up to, but not including, high."""
    f = F.col("frequency")
    return psd.groupBy(*keys).agg(*[F.avg(F.when((f >= low) & (f < high), F.col("psd"))).alias(name) for name, (low, high) in bands.items()])


def line_ratio(psd: DataFrame, keys: list[str], line: float = 50.0) -> DataFrame:
    """keys, ratio: mean density within 2 Hz of the line over that from there to 10 Hz off; 0 without one of them."""
    away = F.abs(F.col("frequency") - line)
    near, flank = F.avg(F.when(away <= 2, F.col("psd"))), F.avg(F.when((away > 2) & (away <= 10), F.col("psd")))
    return psd.groupBy(*keys).agg(F.coalesce(F.try_divide(near, flank), F.lit(0.0)).alias("ratio"))


def wavelet_power(df: DataFrame, rec: str, channel: str, idx: str, value: str, freqs: list[float], sfreq: float, cycles: float = 7.0, chunk: int = 4096) -> DataFrame:
    """rec, channel, idx, frequency, power: power under complex Morlet wavelets, nothing beyond the edges.

    One pass of chunks for each frequency, as wide as its wavelet.
    """
    out = None
    for f in freqs:
        w = wavelet(f, sfreq, cycles)
        z = convolved_with(df, rec, channel, idx, value, {"re": w.real.tolist(), "im": w.imag.tolist()}, chunk, mirrored=False)
        one = z.select(rec, channel, idx, F.lit(float(f)).alias("frequency"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
        out = one if out is None else out.unionByName(one)
    return out


def coherence(spectra: DataFrame, rec: str, channel: str) -> DataFrame:
    """rec, roi_i < roi_j, coherence, icoh: means over the bins of magnitude-squared and absolute imaginary coherence.

    Pairs meet by segment and bin: as many rows as segments, bins and pairs of channels, added up in their
    tasks. A bin in which a channel has no power counts as 0.
    """
    side = lambda x: spectra.select(rec, "wstart", "bin", F.col(channel).alias(f"roi_{x}"), F.col("re").alias(f"r{x}"), F.col("im").alias(f"i{x}"))
    met = side("i").join(side("j"), [rec, "wstart", "bin"]).filter("roi_i < roi_j")
    ri, ii, rj, ij = (F.col(c) for c in ("ri", "ii", "rj", "ij"))
    sums = met.groupBy(rec, "roi_i", "roi_j", "bin").agg(F.sum(ri * rj + ii * ij).alias("_re"), F.sum(ri * ij - ii * rj).alias("_im"), F.sum(ri * ri + ii * ii).alias("_a"), F.sum(rj * rj + ij * ij).alias("_b"))
    both = F.col("_a") * F.col("_b")
    each = sums.select(rec, "roi_i", "roi_j", F.coalesce(F.try_divide(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"), both), F.lit(0.0)).alias("_c"), F.coalesce(F.try_divide(F.abs("_im"), F.sqrt(both)), F.lit(0.0)).alias("_i"))
    return each.groupBy(rec, "roi_i", "roi_j").agg(F.avg("_c").alias("coherence"), F.avg("_i").alias("icoh"))
