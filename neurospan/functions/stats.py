"""Statistics that the operators share; population moments unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_std(column: str) -> list[Column]:
    return [F.avg(column).alias(f"mean_{column}"), F.stddev_pop(column).alias(f"std_{column}")]


def exact_mean(column: Column | str) -> Column:
    """Mean of decimal fractions that doubles hold, whatever the order of summation: 0.05 is 5 hundredths.

    Values and mean are rounded to 18 decimals. Where a value is NaN, infinite or from 10^10 on,
    the plain mean of doubles stands instead.
    """
    value = F.col(column) if isinstance(column, str) else column
    digits = value.try_cast("decimal(28,18)")
    return F.when(F.count(digits) == F.count(value), (F.sum(digits) / F.nullif(F.count(value), F.lit(0))).cast("double")).otherwise(F.avg(value))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, NULL where one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def argmax_first(result: Column | str, value: Column | str, order: Column | str) -> Column:
    """result at the greatest value, the first by order on ties."""
    order = F.col(order) if isinstance(order, str) else order
    return F.max_by(result, F.struct(value, -order))


def argmin_first(result: Column | str, value: Column | str, order: Column | str) -> Column:
    return F.min_by(result, F.struct(value, order))


def distribution(column: str) -> list[Column]:
    """Seven statistics: mean, median, std, min, max, P95, P99, and the count."""
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [
        F.avg(column).alias("mean"), q[0].alias("median"), F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"), q[1].alias("p95"), q[2].alias("p99"), F.count(column).alias("n"),
    ]


def decibels(before: Column, after: Column) -> Column:
    return 10 * F.log10(F.try_divide(before, after))


def robust_z_mad(value: Column, median: Column, mad: Column) -> Column:
    return F.abs(value - median) / (1.4826 * mad + 1e-10)


def sanitise(name: Column) -> Column:
    """Runs of characters that file systems refuse, or white space, become one underscore."""
    return F.btrim(F.regexp_replace(name, r"[/\\:*?\"<>|\s]+", "_"), F.lit("_"))
