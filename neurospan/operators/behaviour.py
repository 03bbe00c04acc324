"""Behavioural summaries, usability rules and quality classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.functions.stats import mean_std


def paradigm_summary(trials: DataFrame, keys: list[str], responded: Column, correct: Column, rt: Column) -> DataFrame:
    """Counts, accuracy (only where someone responded) and reaction time statistics, population std."""
    rt = F.when(responded & rt.isNotNull(), rt)
    return trials.groupBy(*keys).agg(
        F.count("*").alias("n_trials"),
        F.count_if(responded).alias("n_responses"),
        F.count_if(~responded | responded.isNull()).alias("n_missed"),
        F.count_if(correct).alias("n_correct"),
        F.avg(rt).alias("mean_rt"),
        F.percentile(rt, F.lit(0.5)).alias("median_rt"),
        F.stddev_pop(rt).alias("std_rt"),
        F.min(rt).alias("min_rt"),
        F.max(rt).alias("max_rt"),
    ).withColumn("accuracy", F.when(F.col("n_responses") > 0, F.col("n_correct") / F.col("n_trials")))


def usability(summary: DataFrame) -> DataFrame:
    """Adds reasons (array) and usable; thresholds are fixed values."""
    miss = F.try_divide("n_missed", "n_trials")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_trials") == 0, F.lit("No trials")),
        F.when(F.col("accuracy") < 0.5, F.lit("low accuracy")),
        F.when(miss > 0.3, F.lit("high miss rate")),
        F.when(F.col("mean_rt") < 0.1, F.lit("mean rt too short")),
        F.when(F.col("mean_rt") > 3.0, F.lit("mean rt too long")),
        F.when(F.col("std_rt") < 0.05, F.lit("rt without spread")),
    ))
    return summary.withColumn("reasons", reasons).withColumn("usable", F.size("reasons") == 0)


def usability_matrix(blocks: DataFrame, subject: str, paradigm: str, order: list[str], values: list[str]) -> DataFrame:
    """Subject by paradigm: AND over blocks, where an unknown first block is False and later ones don't count."""
    first = F.row_number().over(W.partitionBy(subject, paradigm).orderBy(*order)) == 1
    filled = blocks.withColumn("_u", F.coalesce(F.col("usable"), ~first))
    wide = filled.groupBy(subject).pivot(paradigm, values).agg(F.bool_and("_u"))
    cols = [F.col(f"`{v}`") for v in values]
    available = sum((c.isNotNull().cast("long") for c in cols), F.lit(0))
    usable = sum((F.coalesce(c, F.lit(False)).cast("long") for c in cols), F.lit(0))
    return wide.withColumn("n_available", available.cast("long")).withColumn("n_usable", usable.cast("long"))


def paradigm_stats(summary: DataFrame, paradigm: str) -> DataFrame:
    return summary.groupBy(paradigm).agg(
        F.count("*").alias("total"), F.count_if("usable").alias("n_usable"),
        F.count_if(F.col("n_trials") == 0).alias("n_failed"),
        *mean_std("accuracy"), *mean_std("mean_rt"),
    ).withColumn("usable_rate", F.try_divide("n_usable", "total"))


def quality_class(bad: Column) -> Column:
    """First classifier, percent of bad channels: exactly 10 is excellent."""
    return F.when(bad > 30, "poor").when(bad > 20, "acceptable").when(bad > 10, "good").otherwise("excellent")


def quality_action(bad: Column, severity: Column, ica_ok: Column) -> Column:
    base = F.when(bad > 30, "reject").when(bad > 20, "review").otherwise("accept")
    return (
        F.when((severity == "severe") & (bad > 15), "reject")
        .when((severity == "severe") & (base == "accept"), "review")
        .when((severity == "moderate") & (bad > 10) & (base == "accept"), "review")
        .when(~ica_ok & (bad > 10) & (base == "accept"), "review")
        .otherwise(base)
    )


def quality_class_b(bad: Column, severity: Column) -> Column:
    """Second classifier: exactly 10 is good, and severe clustering caps at acceptable."""
    base = F.when(bad < 10, "excellent").when(bad < 20, "good").when(bad < 30, "acceptable").otherwise("poor")
    return F.when((severity == "severe") & base.isin("excellent", "good"), "acceptable").otherwise(base)


def quality_action_b(quality: Column, ica_ok: Column) -> Column:
    return F.when(quality == "poor", "reject").when(quality == "acceptable", "review").when((quality == "good") & ~ica_ok, "review").otherwise("accept")


def severity(percent: Column) -> Column:
    return F.when(percent == 0, "none").when(percent < 20, "mild").when(percent < 50, "moderate").otherwise("severe")


def usability_score(duration: Column, bad: Column, segments: Column, amplitude: Column, flat: Column, noise: Column) -> Column:
    """From 1 down to 0: shares are fractions, the amplitude is in microvolts."""
    cut = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    total = cut(duration < 60, 0.3) + cut(bad > 0.2, 0.25) + cut(segments > 0.5, 0.25) + cut(amplitude > 500, 0.2) + cut(flat > 0.1, 0.2) + cut(noise > 5, 0.1)
    return F.greatest(F.lit(0.0), 1 - total)


def group_report(df: DataFrame, keys: list[str], subject: str, usable: str, measures: list[str]) -> DataFrame:
    """Counts, means and the sorted list of who is excluded, in one row for each group; excluded() has a row for each of them."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(usable).alias("n_usable"), F.count_if(~F.col(usable)).alias("n_excluded"),
        (100 * F.try_divide(F.count_if(usable), F.count("*"))).alias("percent_usable"),
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
        F.sort_array(F.collect_list(F.when(~F.col(usable), F.col(subject)))).alias("excluded"),
    )


def excluded(df: DataFrame, keys: list[str], subject: str, usable: str) -> DataFrame:
    """keys, subject of what a group report excludes, a row each."""
    return df.filter(~F.col(usable)).select(*keys, subject)


def compare_pipelines(runs: DataFrame, pipeline: str, success: str, measures: list[str]) -> DataFrame:
    """Success rate, then mean and sample std over successful runs; pipelines without any are dropped."""
    ok = lambda m: F.when(F.col(success), F.col(m))
    return runs.groupBy(pipeline).agg(
        F.count("*").alias("n"), (F.count_if(success) / F.count("*")).alias("success_rate"),
        *[F.avg(ok(m)).alias(f"mean_{m}") for m in measures], *[F.stddev_samp(ok(m)).alias(f"std_{m}") for m in measures],
    ).filter("success_rate > 0")
