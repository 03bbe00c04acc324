"""Pairwise metrics between channels that are plain aggregates, and what is derived from edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.operators.windows import time_windows

#: More windows than a recording has, to number those of all recordings.
WINDOWS = 1 << 24


def pair_moments(samples: DataFrame, key: str, values: str = "values") -> DataFrame:
    """key, i, j (i <= j), n, means and co-moment of two channels, from one row per sample.

    Every task folds its samples into one Gram matrix for each key, so what is shuffled is pairs of
    channels for each task, not samples; the partial moments add up. Samples with a missing value
    are left out.
    """
    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for k, part in frame.groupby("k"):
                x = np.stack(part["v"].to_numpy())
                x = x[np.isfinite(x).all(1)]
                if not len(x):
                    continue
                n, s, g = len(x), x.sum(0), x.T @ x
                if k in held:
                    n, s, g = n + held[k][0], s + held[k][1], g + held[k][2]
                held[k] = n, s, g
        for k, (n, s, g) in held.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"k": k, "i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "sij": g[i, j]})

    parts = samples.select(F.col(key).cast("long").alias("k"), F.col(values).alias("v")).mapInPandas(gram, "k long, i int, j int, n long, si double, sj double, sij double")
    return parts.groupBy(F.col("k").alias(key), "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def correlation_edges(samples: DataFrame, key: str, values: str = "values") -> DataFrame:
    """key, roi_i < roi_j, weight; NULL where a channel is constant."""
    m = pair_moments(samples, key, values)
    cov = m.withColumn("cov", F.col("sij") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n"))
    var = cov.filter("i = j").select(key, F.col("i").alias("_c"), F.when(F.col("cov") > 1e-15, F.sqrt("cov")).alias("_sd"))
    a = var.select(key, F.col("_c").alias("i"), F.col("_sd").alias("_si"))
    b = var.select(key, F.col("_c").alias("j"), F.col("_sd").alias("_sj"))
    out = cov.filter("i < j").join(a, [key, "i"]).join(b, [key, "j"])
    return out.select(key, F.col("i").alias("roi_i"), F.col("j").alias("roi_j"), F.try_divide("cov", F.col("_si") * F.col("_sj")).alias("weight"))


def average_ranks(signal: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds rank, ties averaged."""
    n = F.count("*").over(W.partitionBy(*keys, value))
    return signal.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(value)) + (n - 1) / 2)


def spearman_edges(signal: DataFrame, key: str, channel: str, idx: str, value: str, n_channels: int) -> DataFrame:
    ranks = average_ranks(signal, [key, channel], value)
    rows = ranks.groupBy(key, idx).agg(F.sort_array(F.collect_list(F.struct(channel, "rank"))).alias("_r")).filter(F.size("_r") == n_channels)
    return correlation_edges(rows.select(key, F.col("_r.rank").alias("values")), key)


def trial_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys, "roi_i", "roi_j").agg(F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.var_pop("weight").alias("variance"))


def network_means(edges: DataFrame, networks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean weight within and between networks; networks (roi, network) is an atlas of a few hundred rows."""
    side = lambda x: networks.select(F.col("roi").alias(f"roi_{x}"), F.col("network").alias(f"_n{x}"))
    joined = edges.join(side("i"), "roi_i").join(side("j"), "roi_j")
    return joined.groupBy(*keys, F.least("_ni", "_nj").alias("network_a"), F.greatest("_ni", "_nj").alias("network_b")).agg(F.avg("weight").alias("mean"))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumnsRenamed({"roi_i": "_t"}).withColumnRenamed("roi_j", "roi_i").withColumnRenamed("_t", "roi_j"))


def graph_metrics(edges: DataFrame, key: str, diagonal: float = 0.0) -> DataFrame:
    """Threshold (median of positive weights, 0 if none), degree and strength of the graph above it, clustering.

    edges hold roi_i < roi_j; a diagonal above the threshold counts toward degree and strength.
    """
    full = both_directions(edges)
    cut = full.groupBy(key).agg(F.coalesce(F.percentile(F.when(F.col("weight") > 0, F.col("weight")), F.lit(0.5)), F.lit(0.0)).alias("threshold"))
    joined = full.join(cut, key)
    above = F.col("weight") > F.col("threshold")
    self_link = F.when(F.lit(diagonal) > F.col("threshold"), 1).otherwise(0)
    node = joined.groupBy(key, "roi_i", "threshold").agg(F.count_if(above).alias("_d"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("_s"))
    node = node.withColumn("degree", F.col("_d") + self_link).withColumn("strength", F.col("_s") + diagonal)
    # each triangle is met once, from its least to its greatest node, and counts twice for every node
    links = joined.filter(above).filter("roi_i < roi_j").select(key, F.col("roi_i").alias("a"), F.col("roi_j").alias("b"))
    two = links.join(links.select(key, F.col("a").alias("b"), F.col("b").alias("c")), [key, "b"])
    triangles = two.join(links.select(key, "a", F.col("b").alias("c")), [key, "a", "c"])
    closed = triangles.select(key, F.explode(F.array("a", "b", "c")).alias("roi_i")).groupBy(key, "roi_i").agg((2 * F.count("*")).alias("_t"))
    node = node.join(closed, [key, "roi_i"], "left")
    pairs = F.col("_d") * (F.col("_d") - 1)
    node = node.withColumn("clustering", F.coalesce(F.try_divide(F.coalesce("_t", F.lit(0)), F.nullif(pairs, F.lit(0))), F.lit(0.0)))
    return node.groupBy(key, "threshold").agg(
        F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"), F.avg("strength").alias("mean_strength"), F.avg("clustering").alias("clustering"),
    )


def threshold_edges(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.withColumn("weight", F.when(F.abs("weight") < threshold, 0.0).otherwise(F.col("weight")))


def correlation_summary(edges: DataFrame, key: str) -> DataFrame:
    """Missing correlations count as 0: mean, pairs above 0.95 and below 0.1 in size."""
    w = F.coalesce("weight", F.lit(0.0))
    return edges.groupBy(key).agg(F.avg(w).alias("mean"), F.count_if(F.abs(w) > 0.95).alias("n_high"), F.count_if(F.abs(w) < 0.1).alias("n_low"))


def window_edges(samples: DataFrame, sfreq: float, size: float, step: float) -> DataFrame:
    """rec_id, window, roi_i < roi_j, weight: correlations inside sliding windows, from one row per sample."""
    rows = time_windows(samples, "rec_id", "sample_idx", sfreq, size, step)
    edges = correlation_edges(rows.select((F.col("rec_id") * WINDOWS + F.col("window")).alias("_k"), "values"), "_k")
    return edges.select(F.floor(F.col("_k") / WINDOWS).alias("rec_id"), (F.col("_k") % WINDOWS).alias("window"), "roi_i", "roi_j", "weight")


def phase_edges(analytic: DataFrame, key: str) -> DataFrame:
    """PLV, PLI, wPLI, debiased wPLI and the envelopes' correlation from analytic samples (key, idx, roi, re, im): one self-join for all.

    Right for atlases of tens of regions; from a few hundred on use kernels.phase_metrics, which
    keeps a recording's pairs in one task's matrices.
    """
    a = analytic.select(key, "idx", F.col("roi").alias("roi_i"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    b = analytic.select(key, "idx", F.col("roi").alias("roi_j"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    j = a.join(b, [key, "idx"]).filter("roi_i < roi_j")
    re = F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib")
    im = F.col("ia") * F.col("rb") - F.col("ra") * F.col("ib")
    size = F.nullif(F.sqrt(re * re + im * im), F.lit(0.0))
    sq = F.sum(im * im)
    envelope = lambda x: F.sqrt(F.col(f"r{x}") * F.col(f"r{x}") + F.col(f"i{x}") * F.col(f"i{x}"))
    return j.groupBy(key, "roi_i", "roi_j").agg(
        F.sqrt(F.pow(F.avg(re / size), F.lit(2)) + F.pow(F.avg(im / size), F.lit(2))).alias("plv"),
        F.abs(F.avg(F.when(F.abs(im) > 1e-9 * size, F.signum(im)).otherwise(0.0))).alias("pli"),  # rounding has no sign
        F.coalesce(F.try_divide(F.abs(F.avg(im)), F.avg(F.abs(im))), F.lit(0.0)).alias("wpli"),
        F.when(F.pow(F.sum(F.abs(im)), F.lit(2)) - sq > 0, (F.pow(F.sum(im), F.lit(2)) - sq) / (F.pow(F.sum(F.abs(im)), F.lit(2)) - sq)).otherwise(0.0).alias("dwpli"),
        F.corr(envelope("a"), envelope("b")).alias("aec"),
    )
