"""Queries over trials: bins, matches, summaries and quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions.stats import exact_mean
from neurospan.operators import behaviour as be
from neurospan.operators import trials as op
from neurospan.plans.trial_queries import CHAIN, TRIALS, filter_chain
from neurospan.sources.tables import table, trials

def rt() -> F.Column:
    return F.col("response_time")

HALF_DAY = 43_200.0
TRIGGERS = (("flanker", 3, "target_left"), ("flanker", 14, "target_right"), ("flanker", 15, "feedback"), ("restingstate", 20, "eyes_open"), ("restingstate", 30, "eyes_closed"))
CONDITIONS = (("view", ["1", "2"]), ("bought", ["purchase", "3", "4"]), ("low", ["5", "6", "3"]))


def trial_stim_x_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.bin_within(trials(spark, sf_dir), "response_time", 4, "trial_type")
    return df.groupBy("trial_type", "bin").agg(F.count("*").alias("n"), F.round(F.avg(rt()), 6).alias("mean_rt"))


def trial_stim_x_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trials(spark, sf_dir).withColumn("response_time", F.when(F.col("code") >= 5, rt()))
    return op.label_accuracy(df, "trial_type", "accuracy", "response_time").groupBy("bin_name").agg(F.count("*").alias("n"), F.min("trial_idx").alias("first_idx"))


def trial_seq_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.bin_positions(trials(spark, sf_dir), 3, ["subject_id"], "trial_idx")
    return df.groupBy("subject_id", "bin").agg(F.count("*").alias("n"), F.min("trial_idx").alias("first_idx"))


def trial_metadata_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.label_field(trials(spark, sf_dir), "trial_type").groupBy("bin_name").agg(F.count("*").alias("n"), F.round(F.avg(rt()), 6).alias("mean_rt"))


def trial_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bin_equal_width(trials(spark, sf_dir), "response_time", 5).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.max(rt()), 6).alias("max_rt"))


def trial_custom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bin_custom(trials(spark, sf_dir), "response_time", [0.1, 0.25, 0.5, 1.0, 2.0]).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min(rt()), 6).alias("min_rt"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trials(spark, sf_dir)
    responded = F.col("trial_type").isin("click", "purchase") & (rt() > 0)
    return be.usability(be.paradigm_summary(df, ["subject_id", "trial_type"], responded, responded & (F.col("accuracy") == 1), rt()))


ROUNDED = ["accuracy", "mean_rt", "median_rt", "std_rt", "min_rt", "max_rt"]


def behaviour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("subject_id", "trial_type", "n_trials", "n_responses", "n_missed", "n_correct", *[F.round(c, 9).alias(c) for c in ROUNDED])


def behaviour_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("subject_id", "trial_type", F.concat_ws("; ", "reasons").alias("reasons"), "usable")


def paradigm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = be.paradigm_stats(_summary(spark, sf_dir), "trial_type")
    return df.select("trial_type", "total", "n_usable", "n_failed", *[F.round(c, 6).alias(c) for c in ("mean_accuracy", "std_accuracy", "mean_mean_rt", "std_mean_rt", "usable_rate")])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def usability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("paradigm"), "o_orderdate", "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") < 250_000).alias("usable"),
    )
    wide = be.usability_matrix(blocks, "subject_id", "paradigm", ["o_orderdate", "o_orderkey"], PRIORITIES)
    return wide.select("subject_id", *[F.col(f"`{p}`").alias(f"p{p[0]}") for p in PRIORITIES], "n_available", "n_usable")


def response_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trials(spark, sf_dir)
    stim = df.filter("trial_type = 'view'").select("subject_id", F.col("event_id").alias("stim_id"), "onset")
    resp = df.filter("trial_type = 'click'").select("subject_id", F.col("event_id").alias("resp_id"), F.col("onset").alias("t"))
    out = op.match_responses(stim, resp, ["subject_id"], HALF_DAY, HALF_DAY * 5 / 3)
    return out.select("subject_id", "stim_id", "resp_id", F.round(F.col("t") - F.col("onset"), 3).alias("rt"))


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trials(spark, sf_dir)
    left = df.filter("trial_type = 'view'").select("subject_id", "event_id", "trial_idx")
    right = df.filter("trial_type = 'purchase'").select("subject_id", F.col("event_id").alias("purchase_id"), F.col("trial_idx").alias("p_idx"), rt().alias("rt"))
    return op.positional_join(left, right, ["subject_id"], ["trial_idx"], ["p_idx"]).select("subject_id", "event_id", "purchase_id", F.round("rt", 6).alias("rt"))


def trigger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(list(TRIGGERS), "paradigm string, code long, name string")
    paradigm = F.translate(F.lower(F.when(F.col("trial_type") == "view", "Flanker_").otherwise("Resting-State")), "-_", "")
    df = trials(spark, sf_dir).select("event_id", "code", paradigm.alias("paradigm"))
    return df.join(dim, ["paradigm", "code"], "left").select("event_id", F.coalesce("name", F.concat(F.lit("trigger_"), F.col("code").cast("string"))).alias("name"))


def condition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(list(CONDITIONS), "condition string, codes array<string>")
    df = trials(spark, sf_dir).select("event_id", "trial_type", F.col("code").cast("string").alias("code"))
    return op.match_conditions(df, dim, "trial_type", "code").groupBy("condition").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    df = trials(spark, sf_dir).groupBy("trial_type").agg(n.alias("n"))
    total = df.agg(F.sum("n").alias("total"))
    return df.join(F.broadcast(total)).select("trial_type", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def event_code_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trials(spark, sf_dir)
    codes = op.first_appearance_codes(df, "trial_type", ["onset", "event_id"]).withColumnRenamed("code", "event_code")
    return df.join(codes, "trial_type").select("event_id", (F.col("onset") * 250).cast("long").alias("sample"), F.col("code").alias("k"), "event_code")


def name_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of each name, as text."""
    return trials(spark, sf_dir).groupBy("trial_type").agg(F.max_by("code", F.struct("onset", "event_id")).cast("string").alias("value"))


def _qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as recordings: rates from their line items, to the digit, as many lie right at a limit."""
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(F.col("l_suppkey").alias("rec_id")).agg(
        (100 * F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("bad"),
        F.avg((F.col("l_linestatus") == "O").cast("double")).alias("segments"),
        F.max("l_quantity").alias("amplitude"), exact_mean("l_discount").alias("flat"), exact_mean("l_tax").alias("noise"),
        F.count("*").cast("double").alias("duration"),
    )


def quality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _qc(spark, sf_dir).withColumn("bad", F.round(F.col("bad") - 10, 6)).withColumn("severity", be.severity(F.floor(F.col("noise") * 1000) % 70))
    ica = F.col("rec_id") % 3 != 0
    df = df.withColumn("class_a", be.quality_class(F.col("bad"))).withColumn("action_a", be.quality_action(F.col("bad"), F.col("severity"), ica))
    df = df.withColumn("class_b", be.quality_class_b(F.col("bad"), F.col("severity"))).withColumn("action_b", be.quality_action_b(F.col("class_b"), ica))
    return df.select("rec_id", "severity", "class_a", "action_a", "class_b", "action_b")


def qc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _qc(spark, sf_dir)
    score = be.usability_score(F.col("duration") / 10, F.col("bad") / 100, F.col("segments"), F.col("amplitude") * 10.1, F.col("flat") * 2, F.col("noise") * 130)
    return df.select("rec_id", F.round(score, 6).alias("score"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qc(spark, sf_dir).withColumn("usable", F.col("segments") < 0.5).withColumn("site", F.col("rec_id") % 4)


def qc_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = be.group_report(_sites(spark, sf_dir), ["site"], "rec_id", "usable", ["bad", "segments"])
    return out.select("site", "n", "n_usable", "n_excluded", *[F.round(c, 6).alias(c) for c in ("percent_usable", "mean_bad", "mean_segments")], F.array_join(F.transform("excluded", lambda x: x.cast("string")), ",").alias("excluded"))


def qc_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return be.excluded(_sites(spark, sf_dir), ["site"], "rec_id", "usable")


def pipeline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pipeline"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("time"))
    out = be.compare_pipelines(runs, "pipeline", "success", ["time"])
    return out.select("pipeline", "n", *[F.round(c, 4).alias(c) for c in ("success_rate", "mean_time", "std_time")])


QUERIES = {f.__name__: f for f in (
    trial_stim_x_rt, trial_stim_x_accuracy, trial_seq_position, trial_metadata_bins, trial_equal_width, trial_custom_edges, behaviour_summary,
    behaviour_usability, paradigm_stats, usability_matrix, response_match, positional_join, trigger_lookup, condition_match, condition_counts,
    event_code_rank, name_value_map, quality_classes, qc_score, qc_aggregate, qc_excluded, pipeline_compare)}

SUMMARY = f"""{TRIALS}, r AS (SELECT *, trial_type IN ('click', 'purchase') AND response_time > 0 AS responded FROM trials), s AS (
  SELECT subject_id, trial_type, count(*) AS n_trials, count(*) FILTER (responded) AS n_responses, count(*) FILTER (responded IS NOT TRUE) AS n_missed,
         count(*) FILTER (responded AND accuracy = 1) AS n_correct, avg(response_time) FILTER (responded) AS mean_rt, quantile_cont(response_time, 0.5) FILTER (responded) AS median_rt,
         stddev_pop(response_time) FILTER (responded) AS std_rt, min(response_time) FILTER (responded) AS min_rt, max(response_time) FILTER (responded) AS max_rt
  FROM r GROUP BY ALL), a AS (SELECT *, CASE WHEN n_responses > 0 THEN n_correct / n_trials END AS accuracy FROM s), u AS (
  SELECT *, list_filter([CASE WHEN n_trials = 0 THEN 'No trials' END, CASE WHEN accuracy < 0.5 THEN 'low accuracy' END, CASE WHEN n_missed / n_trials > 0.3 THEN 'high miss rate' END,
    CASE WHEN mean_rt < 0.1 THEN 'mean rt too short' END, CASE WHEN mean_rt > 3.0 THEN 'mean rt too long' END, CASE WHEN std_rt < 0.05 THEN 'rt without spread' END], lambda x: x IS NOT NULL) AS reasons FROM a)"""

QC = """q AS (SELECT l_suppkey AS rec_id, 100 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS bad, avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS segments,
  max(l_quantity) AS amplitude, avg(l_discount) AS flat, avg(l_tax) AS noise, CAST(count(*) AS DOUBLE) AS duration FROM lineitem GROUP BY 1)"""

ORACLE = {
    "trial_stim_x_rt": f"""WITH {TRIALS}, e AS (SELECT trial_type, list_distinct(quantile_cont(response_time, [0.25, 0.5, 0.75])) AS q FROM trials GROUP BY 1)
      SELECT t.trial_type, CAST(len(list_filter(q, lambda x: x < response_time)) AS BIGINT) AS bin, count(*) AS n, round(avg(response_time), 6) AS mean_rt
      FROM trials t JOIN e ON t.trial_type = e.trial_type WHERE response_time IS NOT NULL GROUP BY ALL""",
    "trial_stim_x_accuracy": f"""WITH {TRIALS}, t AS (SELECT trial_type, trial_idx, accuracy, CASE WHEN code >= 5 THEN response_time END AS rt FROM trials), x AS (
      SELECT trial_type || '_correct' AS bin_name, trial_idx FROM t WHERE accuracy = 1 UNION ALL SELECT trial_type || '_incorrect', trial_idx FROM t WHERE accuracy = 0
      UNION ALL SELECT trial_type || '_missing', trial_idx FROM t WHERE rt IS NULL OR rt = 0) SELECT bin_name, count(*) AS n, min(trial_idx) AS first_idx FROM x GROUP BY 1""",
    "trial_seq_position": f"""WITH {TRIALS}, t AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM trials)
      SELECT subject_id, least((trial_idx - 1) // (n // 3), 2) AS bin, count(*) AS n, min(trial_idx) AS first_idx FROM t WHERE n >= 3 GROUP BY 1, 2""",
    "trial_metadata_bins": f"WITH {TRIALS} SELECT 'trial_type_' || trial_type AS bin_name, count(*) AS n, round(avg(response_time), 6) AS mean_rt FROM trials WHERE trial_type IS NOT NULL GROUP BY 1",
    "trial_equal_width": f"""WITH {TRIALS}, m AS (SELECT min(response_time) AS lo, max(response_time) AS hi FROM trials)
      SELECT CAST(greatest(least(ceil((response_time - lo) / nullif((hi - lo) / 5, 0)) - 1, 4), 0) AS BIGINT) AS bin, count(*) AS n, round(max(response_time), 6) AS max_rt FROM trials, m WHERE response_time IS NOT NULL GROUP BY 1""",
    "trial_custom_edges": f"""WITH {TRIALS} SELECT CAST((response_time > 0.25)::INT + (response_time > 0.5)::INT + (response_time > 1.0)::INT AS BIGINT) AS bin, count(*) AS n, round(min(response_time), 6) AS min_rt
      FROM trials WHERE response_time > 0.1 AND response_time <= 2.0 GROUP BY 1""",
    "behaviour_summary": f"WITH {SUMMARY} SELECT subject_id, trial_type, n_trials, n_responses, n_missed, n_correct, {', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)} FROM u",
    "behaviour_usability": f"WITH {SUMMARY} SELECT subject_id, trial_type, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS usable FROM u",
    "paradigm_stats": f"""WITH {SUMMARY} SELECT trial_type, count(*) AS total, count(*) FILTER (len(reasons) = 0) AS n_usable, count(*) FILTER (n_trials = 0) AS n_failed, round(avg(accuracy), 6) AS mean_accuracy,
      round(stddev_pop(accuracy), 6) AS std_accuracy, round(avg(mean_rt), 6) AS mean_mean_rt, round(stddev_pop(mean_rt), 6) AS std_mean_rt, round(count(*) FILTER (len(reasons) = 0) / count(*), 6) AS usable_rate FROM u GROUP BY 1""",
    "usability_matrix": f"""WITH b AS (SELECT o_custkey AS subject_id, o_orderpriority AS p, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice < 250000 END, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) > 1) AS u FROM orders),
      g AS (SELECT subject_id, {', '.join(f"bool_and(u) FILTER (p = '{p}') AS p{p[0]}" for p in PRIORITIES)} FROM b GROUP BY 1)
      SELECT *, CAST({' + '.join(f'(p{p[0]} IS NOT NULL)::INT' for p in PRIORITIES)} AS BIGINT) AS n_available, CAST({' + '.join(f'coalesce(p{p[0]}, false)::INT' for p in PRIORITIES)} AS BIGINT) AS n_usable FROM g""",
    "response_match": f"""WITH {TRIALS}, s AS (SELECT subject_id, event_id AS stim_id, onset, least(onset + {HALF_DAY}, coalesce(lead(onset) OVER (PARTITION BY subject_id ORDER BY onset, event_id), onset + {HALF_DAY * 5 / 3})) AS e FROM trials WHERE trial_type = 'view'),
      m AS (SELECT s.subject_id, stim_id, min(r.event_id) AS resp_id FROM s JOIN trials r ON r.trial_type = 'click' AND r.subject_id = s.subject_id AND r.onset > s.onset AND r.onset <= s.e GROUP BY 1, 2)
      SELECT s.subject_id, s.stim_id, m.resp_id, round(r.onset - s.onset, 3) AS rt FROM s LEFT JOIN m ON s.subject_id = m.subject_id AND s.stim_id = m.stim_id LEFT JOIN trials r ON r.event_id = m.resp_id""",
    "positional_join": f"""WITH {TRIALS}, l AS (SELECT subject_id, event_id, row_number() OVER (PARTITION BY subject_id ORDER BY trial_idx) AS i FROM trials WHERE trial_type = 'view'),
      r AS (SELECT subject_id, event_id AS purchase_id, response_time, row_number() OVER (PARTITION BY subject_id ORDER BY trial_idx) AS i FROM trials WHERE trial_type = 'purchase')
      SELECT l.subject_id, event_id, purchase_id, round(response_time, 6) AS rt FROM l LEFT JOIN r ON l.subject_id = r.subject_id AND l.i = r.i""",
    "trigger_lookup": f"""WITH {TRIALS}, d AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {c}, '{n}')" for p, c, n in TRIGGERS)}) v(paradigm, code, name))
      SELECT event_id, coalesce(name, 'trigger_' || t.code) AS name FROM trials t LEFT JOIN d ON d.code = t.code AND d.paradigm = CASE WHEN trial_type = 'view' THEN 'flanker' ELSE 'restingstate' END""",
    "condition_match": f"""WITH {TRIALS}, d AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {codes})" for c, codes in CONDITIONS)}) v(condition, codes)),
      x AS (SELECT condition, event_id FROM trials JOIN d ON trial_type = condition UNION ALL SELECT condition, event_id FROM trials JOIN d ON list_contains(codes, CAST(code AS VARCHAR)) WHERE trial_type NOT IN (SELECT condition FROM d))
      SELECT condition, count(*) AS n, min(event_id) AS first_event FROM x GROUP BY 1""",
    "condition_counts": f"WITH {TRIALS} SELECT trial_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM trials GROUP BY 1",
    "event_code_rank": f"""WITH {TRIALS}, f AS (SELECT trial_type, row_number() OVER (ORDER BY min((onset, event_id)), trial_type) AS event_code FROM trials GROUP BY 1)
      SELECT event_id, CAST(trunc(onset * 250) AS BIGINT) AS sample, code AS k, event_code FROM trials t JOIN f ON t.trial_type = f.trial_type""",
    "name_value_map": f"WITH {TRIALS} SELECT trial_type, CAST(arg_max(code, (onset, event_id)) AS VARCHAR) AS value FROM trials GROUP BY 1",
    "quality_classes": f"""WITH {QC}, s AS (SELECT rec_id, round(bad - 10, 6) AS bad, CAST(floor(noise * 1000) AS BIGINT) % 70 AS pc, rec_id % 3 <> 0 AS ica FROM q),
      v AS (SELECT *, CASE WHEN pc = 0 THEN 'none' WHEN pc < 20 THEN 'mild' WHEN pc < 50 THEN 'moderate' ELSE 'severe' END AS severity, CASE WHEN bad > 30 THEN 'reject' WHEN bad > 20 THEN 'review' ELSE 'accept' END AS act,
        CASE WHEN bad < 10 THEN 'excellent' WHEN bad < 20 THEN 'good' WHEN bad < 30 THEN 'acceptable' ELSE 'poor' END AS qb FROM s),
      w AS (SELECT *, CASE WHEN severity = 'severe' AND qb IN ('excellent', 'good') THEN 'acceptable' ELSE qb END AS class_b FROM v)
      SELECT rec_id, severity, CASE WHEN bad > 30 THEN 'poor' WHEN bad > 20 THEN 'acceptable' WHEN bad > 10 THEN 'good' ELSE 'excellent' END AS class_a,
        CASE WHEN severity = 'severe' AND bad > 15 THEN 'reject' WHEN severity = 'severe' AND act = 'accept' THEN 'review' WHEN severity = 'moderate' AND bad > 10 AND act = 'accept' THEN 'review' WHEN NOT ica AND bad > 10 AND act = 'accept' THEN 'review' ELSE act END AS action_a,
        class_b, CASE WHEN class_b = 'poor' THEN 'reject' WHEN class_b = 'acceptable' THEN 'review' WHEN class_b = 'good' AND NOT ica THEN 'review' ELSE 'accept' END AS action_b FROM w""",
    "qc_score": f"""WITH {QC} SELECT rec_id, round(greatest(0, 1 - ((duration / 10 < 60)::INT * 0.3 + (bad / 100 > 0.2)::INT * 0.25 + (segments > 0.5)::INT * 0.25 + (amplitude * 10.1 > 500)::INT * 0.2 + (flat * 2 > 0.1)::INT * 0.2 + (noise * 130 > 5)::INT * 0.1)::DOUBLE), 6) AS score FROM q""",
    "qc_aggregate": f"""WITH {QC} SELECT rec_id % 4 AS site, count(*) AS n, count(*) FILTER (segments < 0.5) AS n_usable, count(*) FILTER (NOT segments < 0.5) AS n_excluded, round(100 * count(*) FILTER (segments < 0.5) / count(*), 6) AS percent_usable,
      round(avg(bad), 6) AS mean_bad, round(avg(segments), 6) AS mean_segments, coalesce(string_agg(CAST(rec_id AS VARCHAR), ',' ORDER BY rec_id) FILTER (NOT segments < 0.5), '') AS excluded FROM q GROUP BY 1""",
    "qc_excluded": f"WITH {QC} SELECT rec_id % 4 AS site, rec_id FROM q WHERE NOT segments < 0.5",
    "pipeline_compare": """SELECT o_orderpriority AS pipeline, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS success_rate, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_time,
      round(stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS std_time FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0""",
}
