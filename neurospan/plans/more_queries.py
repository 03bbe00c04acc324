"""Queries over linear maps, roll-ups, scans of event files, preprocessing chains and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import source_space as ss
from neurospan.operators import steps
from neurospan.plans.signal_queries import SIG
from neurospan.sources.tables import recordings, signal_long, table
from neurospan.streaming import windows as sw


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = signal_long(spark, sf_dir)
    weights = spark.range(384).select((F.col("id") % 6).cast("int").alias("row"), F.floor(F.col("id") / 6).cast("int").alias("channel"), ((F.col("id") * 7 % 11).cast("double") / 10).alias("weight"))
    return ss.apply_operator(signal, weights, ["rec_id", "sample_idx"])


def source_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("rec_id", "sample_idx", "row", *r("value"))


def roi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.power(ss.extract_regions(_sources(spark, sf_dir), ["rec_id", "sample_idx"], 10, 6), ["rec_id"]).select("rec_id", "roi", *r("power"))


def roi_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.roi_sem(_sources(spark, sf_dir), ["rec_id", "row"]).select("rec_id", "row", *r("mean", "std", "sem"))


def epoch_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(100).alias("total"), F.col("o_totalprice").alias("duration"))
    return ss.apportion(runs, ["o_custkey"], "total", "duration").select("o_orderkey", "o_custkey", "n_epochs")


def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("o_totalprice") > 400_000, "poor").when(F.col("o_totalprice") > 200_000, "good").when(F.col("o_totalprice") > 50_000, "excellent")
    return ss.quality_rollup(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), q.alias("quality")), "task", "quality")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    tall = item.select("run", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in ("discount", "tax")])).alias("_m")).select("run", "_m.*")
    return ss.metric_table(tall, "run", ["discount", "tax"])


def step_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [{"name": "pick", "params": {"channels": [0, 1, 2, 3]}}, {"name": "reference"}, {"name": "decimate", "params": {"factor": 5}}]
    out = steps.run(recordings(spark, sf_dir), chain)
    return out.select("rec_id", "sample_idx", F.posexplode("values").alias("channel", "value")).select("rec_id", "sample_idx", "channel", *r("value"))


def step_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [{"name": "filter", "params": {"sfreq": 250.0, "l_freq": 1.0, "h_freq": 40.0}}, {"name": "notch", "params": {"sfreq": 250.0}}, {"name": "reference"}]
    return steps.run(recordings(spark, sf_dir), chain)


def event_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of candidate columns and how often the most frequent one occurs."""
    ev = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    tall = ev.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ev.columns])).alias("_x")).select("_x.*")
    return tall.groupBy("column", "value").count().groupBy("column").agg(F.count("value").alias("n_distinct"), F.max("count").alias("most"))


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sw.window_stats(ev, "ts", "event_type", "value", "6 hours")
    return out.select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n", *r("mean", "std", "range"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sw.sessions(ev, "ts", "user_id", "12 hours").select(F.unix_micros("session_start").alias("start_us"), "user_id", "n")


QUERIES = {f.__name__: f for f in (source_estimate, roi_extract, roi_sem, epoch_apportion, quality_rollup, metric_table, step_reference, step_filter_chain, event_scan, window_stats, user_sessions)}

SRC = f"""{SIG}, m AS (SELECT i % 6 AS "row", i // 6 AS channel, CAST(i * 7 % 11 AS DOUBLE) / 10 AS weight FROM range(384) t(i)),
  src AS (SELECT rec_id, sample_idx, "row", sum(weight * value) AS value FROM sig JOIN m USING (channel) GROUP BY ALL)"""

ORACLE = {
    "source_estimate": f'WITH {SRC} SELECT rec_id, sample_idx, CAST("row" AS INT) AS "row", round(value, 6) AS value FROM src',
    "roi_extract": f'WITH {SRC}, g AS (SELECT CAST(i AS INT) AS roi, i % 6 AS "row" FROM range(10) t(i)) SELECT rec_id, roi, round(avg(abs(value)), 6) AS power FROM src JOIN g USING ("row") GROUP BY 1, 2',
    "roi_sem": f'WITH {SRC} SELECT rec_id, CAST("row" AS INT) AS "row", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / sqrt(count(*)), 6) AS sem FROM src GROUP BY 1, 2',
    "epoch_apportion": "SELECT o_orderkey, o_custkey, CAST(floor(100 * (o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey))) AS BIGINT) AS n_epochs FROM orders",
    "quality_rollup": """WITH q AS (SELECT o_orderpriority AS task, CASE WHEN o_totalprice > 400000 THEN 'poor' WHEN o_totalprice > 200000 THEN 'good' WHEN o_totalprice > 50000 THEN 'excellent' END AS quality FROM orders)
      SELECT task, count(*) AS n_runs, count(*) FILTER (quality IN ('excellent', 'good')) AS accepted, count(*) FILTER (quality = 'poor') AS rejected, count(quality) AS processed FROM q GROUP BY ROLLUP (task)""",
    "metric_table": "SELECT l_suppkey AS run, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1",
    "step_reference": f"WITH {SIG} SELECT rec_id, sample_idx // 5 AS sample_idx, CAST(channel AS INT) AS channel, round(value - avg(value) OVER (PARTITION BY rec_id, sample_idx), 6) AS value FROM sig WHERE channel < 4 AND sample_idx % 5 = 0",
    "event_scan": """WITH x AS (SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events), c AS (SELECT "column", value, count(*) AS n FROM x GROUP BY ALL)
      SELECT "column", count(value) AS n_distinct, max(n) AS most FROM c GROUP BY 1""",
    "window_stats": """SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_s, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS "range" FROM events GROUP BY 1, 2""",
    "user_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT min(epoch_us(ts)) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}
