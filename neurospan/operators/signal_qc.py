"""Channel quality: variance, correlation and deviation detectors, references, spatial clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.functions.stats import robust_z_mad
from neurospan.operators.connectivity import both_directions


def _median(column: str):
    return F.percentile(column, F.lit(0.5))


def bad_by_variance(signal: DataFrame, limit: float = 5.0) -> DataFrame:
    """rec_id, channel, variance, z (MAD), bad. Channels are few for a recording, so its window is small."""
    var = signal.groupBy("rec_id", "channel").agg(F.var_pop("value").alias("variance"))
    return _mad(var, "variance", limit)


def _mad(df: DataFrame, column: str, limit: float) -> DataFrame:
    med = df.groupBy("rec_id").agg(_median(column).alias("_med"))
    dev = df.join(med, "rec_id").withColumn("_dev", F.abs(F.col(column) - F.col("_med")))
    mad = dev.groupBy("rec_id").agg(_median("_dev").alias("_mad"))
    out = dev.join(mad, "rec_id").withColumn("z", robust_z_mad(F.col(column), F.col("_med"), F.col("_mad")))
    return out.withColumn("bad", F.col("z") > limit).drop("_med", "_dev", "_mad")


def bad_by_correlation(edges: DataFrame, limit: float = 0.4) -> DataFrame:
    """Channels whose median absolute correlation, that with itself included, lies below the limit."""
    full = both_directions(edges.select("rec_id", "roi_i", "roi_j", F.abs(F.coalesce("weight", F.lit(0.0))).alias("weight")))
    own = full.select("rec_id", "roi_i").distinct().select("rec_id", "roi_i", F.col("roi_i").alias("roi_j"), F.lit(1.0).alias("weight"))
    med = full.unionByName(own).groupBy("rec_id", F.col("roi_i").alias("channel")).agg(_median("weight").alias("median_corr"))
    return med.withColumn("bad", F.col("median_corr") < limit)


def bad_by_deviation(signal: DataFrame, limit: float = 5.0) -> DataFrame:
    """Mean squared distance from the cross-channel median of each sample, judged by MAD."""
    med = signal.groupBy("rec_id", "sample_idx").agg(_median("value").alias("_m"))
    d = F.col("value") - F.col("_m")
    dev = signal.join(med, ["rec_id", "sample_idx"]).groupBy("rec_id", "channel").agg(F.avg(d * d).alias("deviation"))
    return _mad(dev, "deviation", limit)


def high_variance(signal: DataFrame, limit: float = 3.0) -> DataFrame:
    """Robust z by interquartile range; recordings whose range vanishes have none."""
    var = signal.groupBy("rec_id", "channel").agg(F.var_pop("value").alias("variance"))
    q = var.groupBy("rec_id").agg(F.percentile("variance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    out = var.join(q, "rec_id").withColumn("_iqr", F.col("_q")[2] - F.col("_q")[0])
    z = (F.col("variance") - F.col("_q")[1]) / (0.7413 * F.col("_iqr"))
    return out.withColumn("z", F.when(F.col("_iqr") >= 1e-10, z)).withColumn("bad", F.coalesce(F.col("z") > limit, F.lit(False))).drop("_q", "_iqr")


def rereference(signal: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Subtracts the mean of the reference channels (all by default) at each sample."""
    ref = F.col("value") if channels is None else F.when(F.col("channel").isin(channels), F.col("value"))
    return signal.withColumn("value", F.col("value") - F.avg(ref).over(W.partitionBy("rec_id", "sample_idx")))


def neighbours(montage: DataFrame, k: int) -> DataFrame:
    """channel, other, rank: the k nearest by distance, ties by channel. A montage has some hundred rows."""
    a = montage.select("channel", "x", "y", "z")
    b = montage.select(F.col("channel").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2)
    near = a.join(b, F.col("channel") != F.col("other")).withColumn("distance", d)
    rank = F.row_number().over(W.partitionBy("channel").orderBy("distance", "other"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("channel", "other", "rank", "distance")


def clustered_bad(near: DataFrame, bad: DataFrame, k: int, share: float = 0.5, inclusive: bool = True) -> DataFrame:
    """rec_id, channel, n_bad of bad channels, clustered where the share of bad neighbours reaches share."""
    hit = bad.join(near, "channel").join(bad.select("rec_id", F.col("channel").alias("other"), F.lit(1).alias("_b")), ["rec_id", "other"], "left")
    out = hit.groupBy("rec_id", "channel").agg(F.count("_b").alias("n_bad"))
    ratio = F.col("n_bad") / k
    return out.withColumn("clustered", ratio >= share if inclusive else ratio > share)


def common_channels(channels: DataFrame) -> DataFrame:
    """Channels that every recording has."""
    n = channels.agg(F.count_distinct("rec_id").alias("_all"))
    return channels.groupBy("channel").agg(F.count_distinct("rec_id").alias("_n")).join(F.broadcast(n)).filter("_n = _all").select("channel")


def concatenate(runs: DataFrame, keys: list[str], order: list[str], duration: str) -> DataFrame:
    """Adds offset: the time of all runs before, by key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0.0)))


def bad_union(detected: list[DataFrame], manual: DataFrame | None = None) -> DataFrame:
    """rec_id and its bad channels, sorted: those of any detector (rec_id, channel, bad) and those given by hand (rec_id, channel)."""
    found = [d.filter("bad").select("rec_id", "channel") for d in detected]
    if manual is not None:
        found.append(manual.select("rec_id", "channel"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("rec_id").agg(F.sort_array(F.collect_set("channel")).alias("bads"))


def positioned(signal: DataFrame, montage: DataFrame) -> DataFrame:
    """The channels that have a finite position (channel, x, y, z)."""
    finite = [~F.isnan(c) & F.col(c).isNotNull() & (F.abs(c) != float("inf")) for c in ("x", "y", "z")]
    return signal.join(montage.filter(finite[0] & finite[1] & finite[2]).select("channel"), "channel", "left_semi")
