"""Event-locked epochs: cutting, rejection, baseline, averages and component features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.functions.stats import argmax_first


def cut(signal: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Samples of each event's window [sample - before, sample + after], with t relative to the event.

    events: rec_id, epoch_id, sample, and more. Every event lists its samples, so the range join is
    an equi-join on (rec_id, sample_idx).
    """
    wanted = events.withColumn("t", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("sample_idx", (F.col("sample") + F.col("t")).cast("long")).drop("sample")
    return signal.join(wanted, ["rec_id", "sample_idx"])


def overlap_anti_join(epochs: DataFrame, intervals: DataFrame, slot: int) -> DataFrame:
    """Epochs (rec_id, start, stop) that overlap no interval (rec_id, lo, hi); ends exclusive.

    Both sides list the slots of samples they touch, so overlaps are found by an equi-join.
    """
    slots = lambda a, z: F.explode(F.sequence(F.floor(a / slot), F.floor((z - 1) / slot)))
    spans = intervals.filter("hi > lo").withColumn("_slot", slots(F.col("lo"), F.col("hi")))
    hit = epochs.withColumn("_slot", slots(F.col("start"), F.col("stop"))).join(spans, ["rec_id", "_slot"]).filter((F.col("lo") < F.col("stop")) & (F.col("hi") > F.col("start")))
    return epochs.join(hit.select("rec_id", "epoch_id").distinct(), ["rec_id", "epoch_id"], "left_anti")


def reject(epochs: DataFrame, reject_above: float | None = None, flat_below: float | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """rec_id, epoch_id, max_ptp, min_ptp, dropped: any channel's peak-to-peak over or under its limit."""
    value = F.col("value") if span is None else F.when(F.col("t").between(*span), F.col("value"))
    ptp = epochs.groupBy("rec_id", "epoch_id", "channel").agg((F.max(value) - F.min(value)).alias("_p"))
    out = ptp.groupBy("rec_id", "epoch_id").agg(F.max("_p").alias("max_ptp"), F.min("_p").alias("min_ptp"))
    over = F.lit(False) if reject_above is None else F.col("max_ptp") > reject_above
    under = F.lit(False) if flat_below is None else F.col("min_ptp") < flat_below
    return out.withColumn("dropped", over | under)


def baseline(epochs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Subtracts each epoch and channel's mean over lo <= t <= hi."""
    mean = F.avg(F.when(F.col("t").between(lo, hi), F.col("value"))).over(W.partitionBy("rec_id", "epoch_id", "channel"))
    return epochs.withColumn("value", F.col("value") - mean)


def detrend(epochs: DataFrame) -> DataFrame:
    """Subtracts each epoch and channel's least-squares line."""
    w = W.partitionBy("rec_id", "epoch_id", "channel")
    slope = F.covar_pop("t", "value").over(w) / F.nullif(F.var_pop("t").over(w), F.lit(0.0))
    fitted = F.avg("value").over(w) + F.coalesce(slope, F.lit(0.0)) * (F.col("t") - F.avg("t").over(w))
    return epochs.withColumn("value", F.col("value") - fitted)


def erp(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("condition", "channel", "t").agg(F.avg("value").alias("value"))


def channel_mean(evoked: DataFrame, channels: list[int] | None = None) -> DataFrame:
    df = evoked if channels is None else evoked.filter(F.col("channel").isin(channels))
    return df.groupBy("condition", "t").agg(F.avg("value").alias("value"))


def peak(wave: DataFrame, lo: int, hi: int, positive: bool = True) -> DataFrame:
    """Amplitude and latency of the first extremum in the closed window, its mean and area.

    The area is the trapezoid sum with the mean step; a condition without samples there is absent.
    """
    inside = wave.filter(F.col("t").between(lo, hi))
    w = W.partitionBy("condition").orderBy("t")
    steps = inside.withColumn("_mid", (F.col("value") + F.lag("value").over(w)) / 2).withColumn("_dt", F.col("t") - F.lag("t").over(w))
    signed = F.col("value") if positive else -F.col("value")
    return steps.groupBy("condition").agg(
        argmax_first("value", signed, "t").alias("amplitude"), argmax_first("t", signed, "t").alias("latency"),
        F.avg("value").alias("mean"), (F.sum("_mid") * F.avg("_dt")).alias("auc"),
    )


def mean_amplitude(wave: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    return wave.groupBy("condition").agg(*[F.avg(F.when(F.col("t").between(*w), F.col("value"))).alias(name) for name, w in windows.items()])


def difference_wave(wave: DataFrame, a: object, b: object) -> DataFrame:
    pick = lambda c: F.avg(F.when(F.col("condition") == c, F.col("value")))
    return wave.groupBy("t").agg((pick(a) - pick(b)).alias("difference"))


def global_field_power(evoked: DataFrame) -> DataFrame:
    """Population std over channels for each condition and t."""
    return evoked.groupBy("condition", "t").agg(F.stddev_pop("value").alias("gfp"))


def band_means(power: DataFrame, bands: Column) -> DataFrame:
    """Mean power by channel and t for each half-open band; bands is an array of struct(name, lo, hi)."""
    b = power.withColumn("_b", F.explode(F.filter(bands, lambda x: (F.col("freq") >= x["lo"]) & (F.col("freq") < x["hi"]))))
    return b.groupBy(F.col("_b.name").alias("band"), "channel", "t").agg(F.avg("power").alias("power"))
