"""Linear maps of channels: source estimates, regions, and their power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_operator(signal: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, value: the matrix (row, channel, weight) times each sample's channels.

    A matrix has some thousand rows for each channel; its partial sums meet before the shuffle.
    """
    joined = signal.join(weights, "channel")
    return joined.groupBy(*keys, "row").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def extract_regions(sources: DataFrame, keys: list[str], n_regions: int, n_sources: int) -> DataFrame:
    """Region i takes source row i mod n_sources."""
    regions = sources.sparkSession.range(n_regions).select(F.col("id").cast("int").alias("roi"), (F.col("id") % n_sources).cast("int").alias("row"))
    return sources.join(regions, "row").select(*keys, "roi", "value")


def average_regions(sources: DataFrame, positions: DataFrame, atlas: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Region means over the sources within radius of its centre; atlas and positions are dimension tables."""
    d = sum(((F.col(f"p.{c}") - F.col(f"a.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    near = positions.alias("p").join(atlas.alias("a"), d <= radius * radius).select("p.row", "a.roi")
    return sources.join(near, "row").groupBy(*keys, "roi").agg(F.avg("value").alias("value"))


def power(regions: DataFrame, keys: list[str]) -> DataFrame:
    return regions.groupBy(*keys, "roi").agg(F.avg(F.abs("value")).alias("power"))


def roi_sem(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population std and its standard error over trials."""
    n = F.count("value")
    return regions.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.stddev_pop("value") / F.sqrt(n)).alias("sem"))


def apportion(runs: DataFrame, keys: list[str], total: str, duration: str) -> DataFrame:
    """Epochs of each run by its share of the time, truncated: an estimate, not a count."""
    share = F.col(duration) / F.sum(duration).over(W.partitionBy(*keys))
    return runs.withColumn("n_epochs", F.floor(F.col(total) * share).cast("long"))


def quality_rollup(runs: DataFrame, task: str, quality: str) -> DataFrame:
    """Runs, accepted, rejected by task, and the grand total as the null task."""
    return runs.rollup(task).agg(
        F.count("*").alias("n_runs"), F.count_if(F.col(quality).isin("excellent", "good")).alias("accepted"), F.count_if(F.col(quality) == "poor").alias("rejected"), F.count(quality).alias("processed"),
    )


def metric_table(metrics: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Tall metrics (key, metric, value) with a column for each name."""
    return metrics.groupBy(key).pivot("metric", names).agg(F.first("value"))
