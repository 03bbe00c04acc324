"""Trial-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import trials as op
from neurospan.sources.tables import trials

TRIALS = """trials AS (
  SELECT user_id AS subject_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial_idx,
         event_id, epoch_us(ts) / 1e6 AS onset, event_type AS trial_type,
         value / 100 AS response_time,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 2 AS DOUBLE) AS accuracy,
         CAST(json_extract(props, '$.k') AS BIGINT) AS code
  FROM events)"""

CHAIN = f"""{TRIALS}, numbered AS (
  SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM trials), chain AS (
  SELECT * FROM numbered WHERE trial_idx > 2 AND response_time > 0
   AND response_time BETWEEN 0.15 AND 2.0 AND accuracy = 1)"""


def filter_chain(df: DataFrame) -> DataFrame:
    """Positions first (they count raw rows), then missing, reaction time and accuracy."""
    df = op.drop_sequential(df, 2, 0, ["subject_id"], "trial_idx")
    df = op.drop_missing_responses(df, "response_time")
    df = op.filter_by_rt(df, "response_time", 0.15, 2.0)
    return op.filter_by_accuracy(df, "accuracy", "correct")


def trial_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_chain(trials(spark, sf_dir)).select("subject_id", "trial_idx", "event_id", "trial_type", F.round("response_time", 6).alias("rt"))


def trial_rt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = op.bin_quantiles(filter_chain(trials(spark, sf_dir)), "response_time", 4)
    rt = F.col("response_time")
    return binned.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.round(F.avg(rt), 6).alias("mean_rt"),
        F.round(F.percentile(rt, F.lit(0.5)), 6).alias("median_rt"),
        F.round(F.stddev_pop(rt), 6).alias("std_rt"),
        F.round(F.min(rt), 6).alias("min_rt"),
        F.round(F.max(rt), 6).alias("max_rt"),
    )


QUERIES = {"trial_filter_chain": trial_filter_chain, "trial_rt_bins": trial_rt_bins}

ORACLE = {
    "trial_filter_chain": f"WITH {CHAIN} SELECT subject_id, trial_idx, event_id, trial_type, round(response_time, 6) AS rt FROM chain",
    "trial_rt_bins": f"""WITH {CHAIN}, e AS (SELECT quantile_cont(response_time, [0.25, 0.5, 0.75]) AS q FROM chain),
      b AS (SELECT response_time AS rt, CAST(len(list_filter(list_distinct(q), lambda x: x < response_time)) AS BIGINT) AS bin FROM chain, e)
      SELECT bin, count(*) AS n, round(avg(rt), 6) AS mean_rt, round(quantile_cont(rt, 0.5), 6) AS median_rt,
             round(stddev_pop(rt), 6) AS std_rt, round(min(rt), 6) AS min_rt, round(max(rt), 6) AS max_rt FROM b GROUP BY bin""",
}
