"""Cluster permutation test over time: masses of clusters against those of sign-flipped data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sign(permutation: Column, subject: Column, seed: int = 0) -> Column:
    """1 or -1 by a digest of seed, permutation and subject; 1 in permutation 0, the data as they are."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), permutation.cast("string"), subject.cast("string")))
    return F.when((permutation == 0) | (F.left(digest, F.lit(1)) < "8"), 1.0).otherwise(-1.0)


def clusters(scores: DataFrame, keys: list[str], time: str, score: str, threshold: float) -> DataFrame:
    """keys, positive, start, stop, mass of runs of consecutive times whose score is beyond the threshold on one side."""
    beyond = scores.filter(F.abs(score) > threshold).withColumn("positive", F.col(score) > 0)
    run = F.col(time) - F.row_number().over(W.partitionBy(*keys, "positive").orderBy(time))
    return beyond.withColumn("_run", run).groupBy(*keys, "positive", "_run").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.sum(F.abs(score)).alias("mass")).drop("_run")


def cluster_test(df: DataFrame, subject: str, time: str, value: str, permutations: int = 1000, threshold: float = 2.0, seed: int = 0) -> DataFrame:
    """positive, start, stop, mass, p of the clusters over time of a one-sample t against 0.

    df has one value for each subject and whole-numbered time; differences of two conditions, say. Each permutation flips whole
    subjects, t is taken anew at each time, and of its clusters the greatest mass counts; p is the share of
    permutations, the data's own among them, whose greatest mass is not below the cluster's. Sums of flipped values are
    taken in each task before the shuffle, so times and permutations are shuffled, not subjects. A time with one subject or
    without spread has no t. Missing values are left out.
    """
    rows = df.select(F.col(subject).alias("_s"), F.col(time).cast("long").alias("time"), F.col(value).cast("double").alias("_v")).dropna()
    each = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    sums = each.groupBy("permutation", "time").agg(F.count("*").alias("n"), F.sum(sign(F.col("permutation"), F.col("_s"), seed) * F.col("_v")).alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    scored = sums.withColumn("t", F.try_divide(mean, spread / F.sqrt("n")))
    found = clusters(scored, ["permutation"], "time", "t", threshold)
    greatest = found.groupBy("permutation").agg(F.max("mass").alias("_most"))  # a row a permutation
    own = found.filter("permutation = 0").drop("permutation")
    near = F.col("_most") >= F.col("mass") - F.lit(1e-9)
    met = own.join(F.broadcast(greatest), near, "left").groupBy("positive", "start", "stop", "mass").agg(F.count("_most").alias("_n"))
    return met.withColumn("p", F.col("_n") / F.lit(permutations + 1)).drop("_n")
