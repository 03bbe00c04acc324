"""Tumbling and hopping windows over samples, masks, and intervals from masks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lengths(df: DataFrame, rec: str, idx: str) -> DataFrame:
    """Samples of each recording, one row a recording."""
    return df.groupBy(rec).agg((F.max(idx) + 1).alias("_n"))


def hop(df: DataFrame, rec: str, idx: str, width: int, step: int) -> DataFrame:
    """A row for each window a sample lies in, wstart added; windows start at 0, step, ... to n - width inclusive.

    A sample lies in ceil(width / step) windows at most, so the rows grow by a constant.
    """
    first = F.greatest(F.ceil((F.col(idx) - width + 1) / step), F.lit(0))
    last = F.floor(F.col(idx) / step)
    out = df.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("wstart", (F.col("_k") * step).cast("long")).drop("_k")
    return out.join(lengths(df, rec, idx), rec).filter(F.col("wstart") + width <= F.col("_n")).drop("_n")


def tumble(df: DataFrame, rec: str, idx: str, width: int) -> DataFrame:
    """Windows of width without overlap; the last start lies strictly before n - width."""
    out = df.withColumn("wstart", (F.floor(F.col(idx) / width) * width).cast("long"))
    return out.join(lengths(df, rec, idx), rec).filter(F.col("wstart") < F.col("_n") - width).drop("_n")


def flat_channels(df: DataFrame, rec: str, channel: str, idx: str, value: str, width: int, threshold: float) -> DataFrame:
    """Channels with a tumbling window whose population std lies below the threshold."""
    stds = tumble(df, rec, idx, width).groupBy(rec, channel, "wstart").agg(F.stddev_pop(value).alias("_sd"))
    return stds.groupBy(rec, channel).agg(F.bool_or(F.col("_sd") < threshold).alias("flat"), F.min("_sd").alias("min_std"))


def low_variance_hops(df: DataFrame, rec: str, channel: str, idx: str, value: str, width: int, threshold: float) -> DataFrame:
    """Channels with a half-overlapping window of variance below the threshold."""
    var = hop(df, rec, idx, width, width // 2).groupBy(rec, channel, "wstart").agg(F.var_pop(value).alias("_v"))
    return var.groupBy(rec, channel).agg(F.bool_or(F.col("_v") < threshold).alias("flat"), F.min("_v").alias("min_var"))


def peak_to_peak(df: DataFrame, rec: str, channel: str, idx: str, value: str, width: int, step: int) -> DataFrame:
    return hop(df, rec, idx, width, step).groupBy(rec, channel, "wstart").agg((F.max(value) - F.min(value)).alias("ptp"))


def amplitude_mask(df: DataFrame, rec: str, channel: str, idx: str, value: str, width: int, threshold: float) -> DataFrame:
    """rec, idx of samples in windows where any channel's peak-to-peak exceeds the threshold."""
    bad = peak_to_peak(df, rec, channel, idx, value, width, width // 2).groupBy(rec, "wstart").agg(F.max("ptp").alias("_p")).filter(F.col("_p") > threshold)
    return bad.select(rec, F.explode(F.sequence(F.col("wstart"), F.col("wstart") + width - 1)).alias(idx)).distinct()


def gradient_mask(df: DataFrame, rec: str, channel: str, idx: str, value: str, threshold: float) -> DataFrame:
    """rec, idx where any channel's step to the next sample exceeds the threshold."""
    nxt = F.lead(value).over(W.partitionBy(rec, channel).orderBy(idx))
    return df.withColumn("_d", F.abs(nxt - F.col(value))).filter(F.col("_d") > threshold).select(rec, idx).distinct()


def flatline_windows(df: DataFrame, rec: str, channel: str, idx: str, value: str, width: int, threshold: float, share: float = 0.1) -> DataFrame:
    """Windows (step = width) in which max(1, int(share * channels)) channels or more are flat."""
    var = hop(df, rec, idx, width, width).groupBy(rec, "wstart", channel).agg(F.var_pop(value).alias("_v"))
    out = var.groupBy(rec, "wstart").agg(F.count_if(F.col("_v") < threshold).alias("n_flat"), F.count("*").alias("_n"))
    return out.filter(F.col("n_flat") >= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n")


def convolved(df: DataFrame, rec: str, channel: str, idx: str, value: str, taps: list[float], chunk: int = 4096) -> DataFrame:
    """rec, channel, idx, value of signals convolved with taps, see convolved_with."""
    return convolved_with(df, rec, channel, idx, value, {value: taps}, chunk)


def analytic(df: DataFrame, rec: str, channel: str, idx: str, value: str, pair: tuple[list[float], list[float]], chunk: int = 4096) -> DataFrame:
    """rec, channel, idx, re, im of signals under a pair of filters in quadrature, one pass for both."""
    return convolved_with(df, rec, channel, idx, value, {"re": pair[0], "im": pair[1]}, chunk)


def convolved_with(df: DataFrame, rec: str, channel: str, idx: str, value: str, filters: dict[str, list[float]], chunk: int = 4096, mirrored: bool = True) -> DataFrame:
    """rec, channel, idx and a column for each filter: signals convolved with an odd number of taps, without delay.

    Edges are mirrored, or else nothing lies beyond them.

    Samples are dealt to chunks of time, those within half the taps of a chunk's edge to the neighbour
    too, so no task holds a recording and any chunk gives the same values. A sum of neighbouring rows is
    all there is to do inside a chunk. Samples are numbered from 0 without gaps; a recording no longer than
    half the taps, and samples within reach of a missing value, have null.
    """
    half = len(next(iter(filters.values()))) // 2
    if any(len(t) != 2 * half + 1 for t in filters.values()):
        raise ValueError("filters have one odd number of taps")
    at, last = F.col(idx), F.col("_n") - 1
    images = [F.when((at >= 1) & (at <= half), -at), F.when((at < last) & (at >= last - half), 2 * last - at)] if mirrored else []
    at_all = F.filter(F.array(at, *images), lambda p: p.isNotNull())
    places = df.select(rec, channel, idx, value).join(lengths(df, rec, idx), rec).filter(last >= (half if mirrored else 0)).select(rec, channel, value, "_n", F.explode(at_all).alias("_at"))
    first, final = F.greatest(F.floor((F.col("_at") - half) / chunk), F.lit(0)), F.least(F.floor((F.col("_at") + half) / chunk), F.floor(last / chunk))
    dealt = places.select(rec, channel, value, "_n", "_at", F.explode(F.sequence(first, final)).alias("_chunk"))
    within = W.partitionBy(rec, channel, "_chunk").orderBy("_at")
    near = dealt.select(rec, channel, "_n", "_at", "_chunk", *[F.lag(value, k - half, None if mirrored else 0.0).over(within).alias(f"_x{k}") for k in range(2 * half + 1)])
    sums = []
    for name, taps in filters.items():
        total = F.lit(0.0)
        for k, tap in enumerate(taps):
            total = total + F.lit(float(tap)) * F.col(f"_x{k}")
        sums.append(total.alias(name))
    done = near.select(rec, channel, "_n", "_at", "_chunk", *sums)
    own = (F.floor(F.col("_at") / chunk) == F.col("_chunk")) & (F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))
    return done.filter(own).select(rec, channel, F.col("_at").cast(dict(df.dtypes)[idx]).alias(idx), *filters)


def muscle_mask(df: DataFrame, rec: str, channel: str, idx: str, value: str, taps: list[float], threshold: float, chunk: int = 4096) -> DataFrame:
    """rec, idx of samples whose size in the taps' band, averaged over channels, has a z-score above the threshold.

    Scores are those of a recording (population std); two passes, of which the second joins a row a recording.
    """
    power = convolved(df, rec, channel, idx, value, taps, chunk).groupBy(rec, idx).agg(F.avg(F.abs(F.col(value))).alias("_p"))
    level = power.groupBy(rec).agg(F.avg("_p").alias("_m"), F.stddev_pop("_p").alias("_sd"))
    return power.join(level, rec).filter(F.try_divide(F.col("_p") - F.col("_m"), F.col("_sd")) > threshold).select(rec, idx)


def islands(mask: DataFrame, rec: str, idx: str, sfreq: float, least: float) -> DataFrame:
    """Runs of consecutive samples as (rec, onset, duration) in seconds, those of least seconds or more."""
    run = F.col(idx) - F.row_number().over(W.partitionBy(rec).orderBy(idx))
    runs = mask.withColumn("_run", run).groupBy(rec, "_run").agg(F.min(idx).alias("_s"), F.count("*").alias("_n"))
    return runs.filter(F.col("_n") / sfreq >= least).select(rec, (F.col("_s") / sfreq).alias("onset"), (F.col("_n") / sfreq).alias("duration"))


def good_samples(df: DataFrame, intervals: DataFrame, rec: str, idx: str, sfreq: float) -> DataFrame:
    """Samples outside every interval; bounds are truncated to samples, ends exclusive.

    Intervals become the samples they cover, so the anti join is an equi-join on (rec, idx).
    """
    start, stop = F.floor(F.round(F.col("onset") * sfreq, 6)), F.floor(F.round((F.col("onset") + F.col("duration")) * sfreq, 6))
    covered = intervals.filter(stop > start).select(rec, F.explode(F.sequence(start, stop - 1)).alias(idx)).distinct()
    return df.join(covered, [rec, idx], "left_anti")


def rms(df: DataFrame, rec: str, idx: str, value: str, width: int) -> DataFrame:
    """Root mean square over all channels in tumbling windows, the last one as long as it is."""
    return df.groupBy(rec, (F.floor(F.col(idx) / width)).cast("long").alias("window")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def density(ptp: DataFrame, rec: str, threshold: DataFrame, bin_samples: int, n: DataFrame) -> DataFrame:
    """Windows above their recording's threshold by bin of samples, over the bin's real length."""
    start = F.floor(F.col("wstart") / bin_samples)
    hits = ptp.join(threshold, rec).withColumn("bin", start.cast("long")).groupBy(rec, "bin").agg(F.count_if(F.col("ptp") > F.col("threshold")).alias("n_above"))
    length = F.least(F.lit(bin_samples), F.col("_n") - F.col("bin") * bin_samples)
    return hits.join(n, rec).withColumn("density", F.col("n_above") / length).drop("_n")


def time_windows(samples: DataFrame, rec: str, idx: str, sfreq: float, size: float, step: float) -> DataFrame:
    """A row for each window of size seconds that a sample lies in, window added; windows start every step seconds.

    Starts and ends are truncated to samples, so windows may differ by a sample; the last one may
    reach beyond the end.
    """
    around = F.floor(F.col(idx) / (step * sfreq))
    k = F.explode(F.sequence(F.greatest(around - math.ceil(size / step) - 1, F.lit(0)), around + 1))
    out = samples.withColumn("window", k)
    inside = (F.floor(F.col("window") * step * sfreq) <= F.col(idx)) & (F.col(idx) < F.floor((F.col("window") * step + size) * sfreq))
    n = F.ceil(((F.col("_n") - 1) / sfreq - size + step) / step)
    return out.filter(inside).join(lengths(samples, rec, idx), rec).filter(F.col("window") < n).drop("_n")


def annotations(df: DataFrame, rec: str, channel: str, idx: str, value: str, sfreq: float, width: int, amplitude: float | None = None, gradient: float | None = None, flatline: float | None = None, least: float = 0.0, muscle: float | None = None, taps: list[float] | None = None) -> DataFrame:
    """rec, description, onset, duration of every kind of artifact that has a limit: amplitude, gradient, flatline, muscle.

    muscle, a z-score, needs the taps of the band's filter.
    """
    found = []
    if amplitude is not None:
        found.append(("BAD_amplitude", islands(amplitude_mask(df, rec, channel, idx, value, width, amplitude), rec, idx, sfreq, least)))
    if gradient is not None:
        found.append(("BAD_gradient", islands(gradient_mask(df, rec, channel, idx, value, gradient), rec, idx, sfreq, least)))
    if flatline is not None:
        flat = flatline_windows(df, rec, channel, idx, value, width, flatline)
        found.append(("BAD_flatline", flat.select(rec, (F.col("wstart") / sfreq).alias("onset"), F.lit(width / sfreq).alias("duration"))))
    if muscle is not None:
        found.append(("BAD_muscle", islands(muscle_mask(df, rec, channel, idx, value, taps, muscle), rec, idx, sfreq, least)))
    rows = [x.select(rec, F.lit(name).alias("description"), "onset", "duration") for name, x in found]
    if not rows:
        return df.select(rec, F.lit("").alias("description"), F.lit(0.0).alias("onset"), F.lit(0.0).alias("duration")).limit(0)
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def bad_intervals(marks: DataFrame) -> DataFrame:
    """Annotations whose description holds bad in any case."""
    return marks.filter(F.contains(F.lower("description"), F.lit("bad")))
