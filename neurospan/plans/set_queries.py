"""Queries over unions of detectors and annotations, bins by configuration, listings and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import connectivity as cn
from neurospan.operators import models as mo
from neurospan.operators import signal_qc as qc
from neurospan.operators import trials as tr
from neurospan.operators import windows as wi
from neurospan.plans.signal_queries import AMPLITUDE, CONV, EDGE, GRADIENT, MUSCLE, REC, SFREQ, SIG, VAR, Z_MUSCLE, _gradient, _hop, _mad
from neurospan.plans.trial_queries import TRIALS
from neurospan.sources import listing as li
from neurospan.sources.tables import recordings, signal_long, table, trials


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def window_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.window_edges(recordings(spark, sf_dir), SFREQ, 0.1, 0.05).select("rec_id", "window", "roi_i", "roi_j", *r("weight"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.annotations(signal_long(spark, sf_dir), *REC, SFREQ, 20, AMPLITUDE, GRADIENT, 0.0085, muscle=Z_MUSCLE, taps=MUSCLE)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("rec_id", "description", *r("onset", "duration"))


def good_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples outside annotations whose description holds bad in any case; those of amplitude are renamed and don't count."""
    marks = _marks(spark, sf_dir).withColumn("description", F.when(F.contains("description", F.lit("amplitude")), "note").otherwise(F.initcap("description")))
    out = wi.good_samples(signal_long(spark, sf_dir), wi.bad_intervals(marks), "rec_id", "sample_idx", SFREQ)
    return out.groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def bad_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = signal_long(spark, sf_dir)
    edges = cn.correlation_edges(recordings(spark, sf_dir), "rec_id")
    manual = signal.select("rec_id").distinct().withColumn("channel", F.explode(F.array(F.lit(3), F.lit(17))))
    found = qc.bad_union([qc.bad_by_variance(signal, 2.0), qc.bad_by_deviation(signal, 2.0), qc.bad_by_correlation(edges, 0.04)], manual)
    return found.select("rec_id", F.concat_ws(",", F.transform("bads", lambda x: x.cast("string"))).alias("bads"))


def montage_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = spark.range(60).select(F.col("id").cast("int").alias("channel"), F.when(F.col("id") % 7 == 3, float("nan")).otherwise(F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 11 == 5, float("inf")).otherwise(0.0).alias("y"), F.lit(0.0).alias("z"))
    return qc.positioned(signal_long(spark, sf_dir), place).groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


CONFIGS = [
    {"type": "rt_quantiles", "bins": 4, "prefix": "rt"},
    {"type": "field", "field": "trial_type"},
    {"type": "accuracy", "stimulus": "trial_type"},
    {"type": "positions", "bins": 3, "prefix": "position"},
    {"type": "rt_quantiles", "bins": 2, "prefix": "rt"},
]


def bin_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations make rt_q1 and rt_q2: the later one has them."""
    out = tr.apply_bins(trials(spark, sf_dir), CONFIGS)
    return out.groupBy("bin_name").agg(F.count("*").alias("n"), F.round(F.avg("response_time"), 6).alias("mean_rt"))


def bin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.apply_bins(trials(spark, sf_dir), []).groupBy("bin_name").agg(F.count("*").alias("n"))


def extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of events beyond the standard ones, and how often each occurs."""
    keys = F.array_union(F.json_object_keys("props"), F.array(F.lit("onset"), F.lit("duration"), F.lit("note")))
    extra = F.array_except(keys, F.array(F.lit("onset"), F.lit("duration"), F.lit("trial_type")))
    return table(spark, sf_dir, "events").select(F.explode(extra).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


NAMES = ("SAIIT_2AFC", "SurroundSupp", "SurrSupp", "vis_learn", "WISC_ProcSpeed", "Video", "Other")
SUFFIXES = ("_Block1", "_Block2", "3", "", "_x4")


def _pick(k: F.Column, names: tuple) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def behaviour_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    subject = F.concat(F.lit("ND"), (F.col("o_custkey") % 9).cast("string"), F.lit("A"))
    files = table(spark, sf_dir, "orders").select("o_orderkey", subject.alias("subject"), F.concat(F.lit("/b/"), subject, F.lit("_"), _pick(k, NAMES), _pick(F.floor(k / 7), SUFFIXES), F.lit(".mat")).alias("path"))
    return li.behaviour_files(files).select("o_orderkey", "paradigm", "block")


STAGES = ("preprocessing/standard", "preprocessing", "epochs/v2", "none")
REPORTS = ("_preprocessed_qc.html", "_combined_qc.html", "_raw_qc.html", "_ica_qc.html", "_qc.txt")


def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    subject = F.concat(F.lit("sub-"), (F.col("o_custkey") % 50).cast("string"))
    run = F.when(k % 4 != 0, F.concat(F.lit("/run-"), (k % 3).cast("string"))).otherwise("")
    path = F.concat(F.lit("/d/derivatives/"), _pick(k, STAGES), F.lit("/"), subject, F.lit("/task-rest"), run, F.lit("/"), subject, _pick(F.floor(k / 4), REPORTS))
    return li.report_files(table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))).select("o_orderkey", "subject", "task", "run", "pipeline", "type")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a subject, the newest first."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/d/sub-"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), F.lpad(k.cast("string"), 9, "0"), _pick(F.floor(k / 4), REPORTS))
    files = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return li.newest(li.report_files(files), ["subject"]).select("o_orderkey", "subject", F.col("place").cast("long").alias("place"))


STARTS = ("RestingState", "SAIIT_2AFC_Block1", "SAIIT_Block2", "Video-DM", "Video", "VisLearn", "SurroundSupp_Block2", "SurrSupp", "WISC", "Other")
PLACES = ("/EEG/raw/mat_format/", "/EEG/raw/csv_format/", "/EEG/raw/csv_format/", "/Behavioral/mat_format/")


def paradigm_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as delivered: the MAT files of a subject and paradigm, or its CSV files where there are none."""
    k = F.col("o_orderkey")
    place = _pick(F.floor(k / 3), PLACES)
    path = F.concat(F.lit("/raw/"), _pick(k, ("NDAR", "NDAR", "X")), (F.col("o_custkey") % 700).cast("string"), place, _pick(F.floor(k / 2), STARTS), F.when(F.contains(place, F.lit("mat_")), ".mat").otherwise("_data.csv"))
    return li.paradigm_files(table(spark, sf_dir, "orders").select(path.alias("path")).distinct())


def quality_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat((F.col("o_custkey") % 50).cast("string"), F.lit("_ses-"), _pick(k, ("1", "02", "x")), F.lit("_task-rest_run-"), (k % 5).cast("string"), _pick(F.floor(k / 3), ("_qc_metrics.json", "_qc_metrics.json", "_metrics.json")))
    return li.quality_names(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/q/"), name).alias("path"))).select("o_orderkey", "subject", "session", "task", "run")


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_totalprice") > 150_000, "1-URGENT").otherwise("6-NONE")
    return mo.macro_metrics(o.select("o_orderpriority", said.alias("said")), "o_orderpriority", "said").select("n_classes", *r("accuracy", "precision", "recall", "f1"))


QUERIES = {f.__name__: f for f in (window_corr, annotated, good_annotated, bad_channels, montage_finite, bin_dispatch, bin_all, extra_fields, behaviour_listing, report_listing, report_order, paradigm_listing, quality_listing, macro_metrics)}

MARKS = f"""{SIG}, {CONV}, {_hop(20, 10)}, wide AS (SELECT DISTINCT rec_id, wstart FROM (SELECT rec_id, wstart, channel FROM hop GROUP BY ALL HAVING max(value) - min(value) > {AMPLITUDE})),
  m AS (SELECT DISTINCT rec_id, 'BAD_amplitude' AS description, unnest(range(wstart, wstart + 20)) AS sample_idx FROM wide UNION ALL SELECT rec_id, 'BAD_gradient', sample_idx FROM ({_gradient(GRADIENT)}) UNION ALL SELECT rec_id, 'BAD_muscle', sample_idx FROM muscle),
  run AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY rec_id, description ORDER BY sample_idx) AS g FROM m),
  flat AS (SELECT rec_id, wstart FROM (SELECT rec_id, wstart, channel, var_pop(value) AS v FROM hop WHERE wstart % 20 = 0 GROUP BY ALL) GROUP BY 1, 2 HAVING count(*) FILTER (v < 0.0085) >= greatest(1, floor(count(*) * 0.1))),
  marks AS (SELECT rec_id, description, min(sample_idx) / {SFREQ}::DOUBLE AS onset, count(*) / {SFREQ}::DOUBLE AS duration, min(sample_idx) AS a, count(*) AS k FROM run GROUP BY rec_id, description, g
    UNION ALL SELECT rec_id, 'BAD_flatline', wstart / {SFREQ}::DOUBLE, 20 / {SFREQ}::DOUBLE, wstart, 20 FROM flat)"""
ORD = "[{}][CAST({} AS BIGINT) % {} + 1]"


def _choice(key: str, names: tuple) -> str:
    return ORD.format(", ".join(f"'{n}'" for n in names), key, len(names))


def _first(name: str, pairs: tuple) -> str:
    return "CASE " + " ".join(f"WHEN contains({name}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


RT = "SELECT response_time AS rt, CAST(len(list_filter(list_distinct(q), lambda x: x < response_time)) AS BIGINT) AS b FROM trials, (SELECT quantile_cont(response_time, {}) AS q FROM trials WHERE response_time > 0) WHERE response_time > 0"

ORACLE = {
    "window_corr": f"""WITH {SIG}, w AS (SELECT s.rec_id, channel, sample_idx, k AS "window", value FROM sig s JOIN len USING (rec_id), LATERAL (SELECT unnest(range(0, CAST(ceil(((n - 1) / {SFREQ}::DOUBLE - 0.1::DOUBLE + 0.05::DOUBLE) / 0.05::DOUBLE) AS BIGINT))) AS k) x
      WHERE sample_idx >= floor(k * 0.05::DOUBLE * {SFREQ}::DOUBLE) AND sample_idx < floor((k * 0.05::DOUBLE + 0.1::DOUBLE) * {SFREQ}::DOUBLE))
      SELECT a.rec_id, a."window", a.channel AS roi_i, b.channel AS roi_j, round(corr(a.value, b.value), 6) AS weight FROM w a JOIN w b ON a.rec_id = b.rec_id AND a."window" = b."window" AND a.sample_idx = b.sample_idx AND a.channel < b.channel GROUP BY 1, 2, 3, 4""",
    "annotated": f"WITH {MARKS} SELECT rec_id, description, round(onset, 6) AS onset, round(duration, 6) AS duration FROM marks",
    "good_annotated": f"""WITH {MARKS}, bad AS (SELECT DISTINCT rec_id, unnest(range(a, a + k)) AS sample_idx FROM marks WHERE description <> 'BAD_amplitude')
      SELECT rec_id, channel, count(*) AS n, round(avg(value), 6) AS mean FROM sig s WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.rec_id = s.rec_id AND bad.sample_idx = s.sample_idx) GROUP BY 1, 2""",
    "bad_channels": f"""WITH v AS (WITH {_mad('variance', VAR, 2.0)}), d AS (WITH {_mad('deviation', 'cm AS (SELECT rec_id, sample_idx, quantile_cont(value, 0.5) AS c FROM sig GROUP BY ALL), src AS (SELECT rec_id, channel, avg((value - c) * (value - c)) AS deviation FROM sig JOIN cm USING (rec_id, sample_idx) GROUP BY ALL)', 2.0)}),
      c AS (WITH {EDGE}, f AS (SELECT rec_id, roi_i AS channel, abs(coalesce(weight, 0)) AS w FROM full_ UNION ALL SELECT DISTINCT rec_id, roi_i, 1.0 FROM full_) SELECT rec_id, channel, quantile_cont(w, 0.5) < 0.04 AS bad FROM f GROUP BY 1, 2),
      u AS (SELECT rec_id, channel FROM v WHERE bad UNION SELECT rec_id, channel FROM d WHERE bad UNION SELECT rec_id, channel FROM c WHERE bad UNION SELECT DISTINCT rec_id, unnest([3, 17]) FROM v)
      SELECT rec_id, string_agg(CAST(channel AS VARCHAR), ',' ORDER BY channel) AS bads FROM u GROUP BY 1""",
    "montage_finite": f"WITH {SIG} SELECT rec_id, CAST(channel AS INT) AS channel, count(*) AS n, round(avg(value), 6) AS mean FROM sig WHERE channel < 60 AND channel % 7 <> 3 AND channel % 11 <> 5 GROUP BY 1, 2",
    "bin_dispatch": f"""WITH {TRIALS}, four AS ({RT.format('[0.25, 0.5, 0.75]')}), two AS ({RT.format('[0.5]')}),
      p AS (SELECT response_time AS rt, least((trial_idx - 1) // (n // 3), 2) AS b FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM trials) WHERE n >= 3),
      x AS (SELECT 'rt_q' || (b + 1) AS bin_name, rt FROM four WHERE b >= 2 UNION ALL SELECT 'rt_q' || (b + 1), rt FROM two UNION ALL SELECT 'trial_type_' || trial_type, response_time FROM trials UNION ALL SELECT 'position_q' || (b + 1), rt FROM p
        UNION ALL SELECT trial_type || '_' || CASE WHEN accuracy = 1 THEN 'correct' ELSE 'incorrect' END, response_time FROM trials WHERE accuracy IN (0, 1) UNION ALL SELECT trial_type || '_missing', response_time FROM trials WHERE response_time IS NULL OR response_time = 0)
      SELECT bin_name, count(*) AS n, round(avg(rt), 6) AS mean_rt FROM x GROUP BY 1""",
    "bin_all": "SELECT 'all' AS bin_name, count(*) AS n FROM events",
    "extra_fields": """SELECT field, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(json_keys(props), ['onset', 'duration', 'note']))) AS field FROM events) WHERE field NOT IN ('onset', 'duration', 'trial_type') GROUP BY 1""",
    "behaviour_listing": f"""WITH n AS (SELECT o_orderkey, replace('ND' || (o_custkey % 9) || 'A_' || {_choice('o_orderkey', NAMES)} || {_choice('o_orderkey // 7', SUFFIXES)}, 'ND' || (o_custkey % 9) || 'A_', '') AS name FROM orders),
      p AS (SELECT o_orderkey, {_first('name', li.PARADIGMS)} AS paradigm, {_first('name', tuple((b, b.strip('_')) for b in li.BLOCKS))} AS block FROM n) SELECT * FROM p WHERE paradigm IS NOT NULL""",
    "report_listing": f"""WITH f AS (SELECT o_orderkey, o_custkey % 50 AS s, {_choice('o_orderkey', STAGES)} AS stage, {_choice('o_orderkey // 4', REPORTS)} AS file FROM orders)
      SELECT o_orderkey, CAST(s AS VARCHAR) AS subject, 'rest' AS task, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE 'N/A' END AS run, CASE WHEN contains(stage, '/') THEN stage ELSE 'Unknown' END AS pipeline,
        CASE WHEN contains(file, 'preprocessed_qc') THEN 'Preprocessed' WHEN contains(file, 'combined_qc') THEN 'Combined' WHEN contains(file, 'raw_qc') THEN 'Raw Data' ELSE 'Other' END AS type FROM f WHERE file LIKE '%\\_qc.html' ESCAPE '\\'""",
    "report_order": f"""SELECT o_orderkey, CAST(o_custkey % 50 AS VARCHAR) AS subject, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS place FROM orders WHERE {_choice('o_orderkey // 4', REPORTS)} LIKE '%\\_qc.html' ESCAPE '\\'""",
    "paradigm_listing": f"""WITH f AS (SELECT DISTINCT {_choice('o_orderkey', ('NDAR', 'NDAR', 'X'))} || (o_custkey % 700) AS subject, {_choice('o_orderkey // 3', PLACES)} AS place, {_choice('o_orderkey // 2', STARTS)} AS name FROM orders),
      m AS (SELECT subject, CASE WHEN contains(place, 'mat_') THEN 'mat' ELSE 'csv' END AS format, '/raw/' || subject || place || name || CASE WHEN contains(place, 'mat_') THEN '.mat' ELSE '_data.csv' END AS path, name, unnest([{', '.join(f"{{'p': '{p}', 's': list_filter([{', '.join(repr(x) for x in starts)}], lambda x: starts_with(name, x))[1]}}" for p, starts in li.RECORDED.items())}]) AS c FROM f WHERE subject LIKE 'NDAR%' AND place LIKE '/EEG%'),
      v AS (SELECT subject, c.p AS paradigm, path, format, CASE WHEN name = c.s THEN c.s ELSE c.s || '_' || trim(replace(name || CASE WHEN format = 'csv' THEN '_data' ELSE '' END, c.s, ''), '_-') END AS variant FROM m WHERE c.s IS NOT NULL),
      w AS (SELECT *, bool_or(format = 'mat') OVER (PARTITION BY subject, paradigm) AS has, row_number() OVER (PARTITION BY subject, paradigm, format, variant ORDER BY path) AS k FROM v)
      SELECT subject, paradigm, path, format, variant FROM w WHERE (format = 'mat' OR NOT has) AND (format = 'mat' OR k = 1)""",
    "quality_listing": f"""WITH f AS (SELECT o_orderkey, CAST(o_custkey % 50 AS VARCHAR) AS subject, {_choice('o_orderkey', ('1', '02', 'x'))} AS session, 'rest' AS task, CAST(o_orderkey % 5 AS VARCHAR) AS run, {_choice('o_orderkey // 3', ('_qc_metrics.json', '_qc_metrics.json', '_metrics.json'))} AS tail FROM orders)
      SELECT o_orderkey, subject, session, task, run FROM f WHERE session <> 'x' AND tail = '_qc_metrics.json'""",
    "macro_metrics": """WITH o AS (SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_totalprice > 150000 THEN '1-URGENT' ELSE '6-NONE' END AS p FROM orders), l AS (SELECT t AS c FROM o UNION SELECT p FROM o),
      s AS (SELECT c, (SELECT count(*) FROM o WHERE t = c) AS nt, (SELECT count(*) FROM o WHERE p = c) AS np, (SELECT count(*) FROM o WHERE t = c AND p = c) AS hit FROM l)
      SELECT count(*) AS n_classes, round(sum(hit) / sum(nt), 6) AS accuracy, round(avg(coalesce(hit / nullif(np, 0), 0)), 6) AS "precision", round(avg(coalesce(hit / nullif(nt, 0), 0)), 6) AS recall, round(avg(coalesce(2 * hit / nullif(nt + np, 0), 0)), 6) AS f1 FROM s""",
}
