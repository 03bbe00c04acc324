"""Queries over recordings: windows, epochs, channel quality and connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions.kernels import fir
from neurospan.functions.stats import distribution
from neurospan.operators import connectivity as cn
from neurospan.operators import epochs as ep
from neurospan.operators import signal_qc as qc
from neurospan.operators import windows as wi
from neurospan.sources.tables import recordings, signal_long

SFREQ = 250.0
BEFORE, AFTER, EVERY = 10, 29, 40
#: Limits that single samples of some of all 64 channels pass.
AMPLITUDE, GRADIENT, STEEP = 0.76, 0.55, 0.65
REC = ("rec_id", "channel", "sample_idx", "value")
#: Taps of the muscle band's filter at this sampling rate, and the z-score that marks a sample.
MUSCLE, Z_MUSCLE = fir(70.0, 110.0, SFREQ, 33).tolist(), 1.5


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def tumble_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.flat_channels(signal_long(spark, sf_dir), *REC, 25, 0.08).select("rec_id", "channel", "flat", *r("min_std"))


def hop_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.low_variance_hops(signal_long(spark, sf_dir), *REC, 20, 0.005).select("rec_id", "channel", "flat", *r("min_var"))


def hop_ptp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ptp = wi.peak_to_peak(signal_long(spark, sf_dir), *REC, 25, 12)
    q = F.percentile("ptp", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return ptp.groupBy("rec_id").agg(F.count("*").alias("n"), F.round(q[0], 6).alias("median"), F.round(q[1], 6).alias("p90"), F.round(q[2], 6).alias("p95"))


def amplitude_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = wi.amplitude_mask(signal_long(spark, sf_dir), *REC, 20, AMPLITUDE)
    return wi.islands(mask, "rec_id", "sample_idx", SFREQ, 0.1).select("rec_id", *r("onset", "duration"))


def gradient_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = wi.gradient_mask(signal_long(spark, sf_dir), *REC, GRADIENT)
    return wi.islands(mask, "rec_id", "sample_idx", SFREQ, 0.008).select("rec_id", *r("onset", "duration"))


def muscle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = wi.muscle_mask(signal_long(spark, sf_dir), *REC, MUSCLE, Z_MUSCLE)
    return wi.islands(mask, "rec_id", "sample_idx", SFREQ, 0.004).select("rec_id", *r("onset", "duration"))


def band_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square and peak of every channel in the muscle band."""
    y = wi.convolved(signal_long(spark, sf_dir), *REC, MUSCLE)
    return y.groupBy("rec_id", "channel").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.round(F.max(F.abs("value")), 6).alias("peak"))


def flatline_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.flatline_windows(signal_long(spark, sf_dir), *REC, 25, 0.011)


def good_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = signal_long(spark, sf_dir)
    mask = wi.gradient_mask(signal, *REC, GRADIENT)
    bad = wi.islands(mask, "rec_id", "sample_idx", SFREQ, 0.0)
    return wi.good_samples(signal, bad, "rec_id", "sample_idx", SFREQ).groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def rms_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.rms(signal_long(spark, sf_dir), "rec_id", "sample_idx", "value", 50).select("rec_id", "window", *r("rms"))


def artifact_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = signal_long(spark, sf_dir)
    ptp = wi.peak_to_peak(signal, *REC, 20, 10)
    limit = ptp.groupBy("rec_id").agg(F.percentile("ptp", F.lit(0.95)).alias("threshold"))
    return wi.density(ptp, "rec_id", limit, 100, wi.lengths(signal, "rec_id", "sample_idx")).select("rec_id", "bin", "n_above", *r("density"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = recordings(spark, sf_dir).filter((F.col("sample_idx") % EVERY == BEFORE) & (F.col("sample_idx") + AFTER < 250))
    return every.select("rec_id", F.floor(F.col("sample_idx") / EVERY).alias("epoch_id"), F.col("sample_idx").alias("sample"), (F.col("condition") % 3).alias("condition"))


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.cut(signal_long(spark, sf_dir).drop("condition"), _events(spark, sf_dir), BEFORE, AFTER)


def epoch_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir).groupBy("rec_id", "epoch_id", "condition").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.round(F.sum("value"), 6).alias("total"))


def epoch_bad_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = wi.gradient_mask(signal_long(spark, sf_dir), *REC, STEEP)
    bad = wi.islands(mask, "rec_id", "sample_idx", 1.0, 0.0).select("rec_id", F.col("onset").alias("lo"), (F.col("onset") + F.col("duration")).alias("hi"))
    spans = _events(spark, sf_dir).select("rec_id", "epoch_id", (F.col("sample") - BEFORE).alias("start"), (F.col("sample") + AFTER + 1).alias("stop"))
    return ep.overlap_anti_join(spans, bad, 50).select("rec_id", "epoch_id", "start", "stop")


def epoch_ptp_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.reject(_epochs(spark, sf_dir), 0.8, 0.3).select("rec_id", "epoch_id", *r("max_ptp", "min_ptp"), "dropped")


def baseline_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.baseline(_epochs(spark, sf_dir), -BEFORE, -1).select("rec_id", "epoch_id", "channel", "t", *r("value"))


def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.detrend(_epochs(spark, sf_dir)).select("rec_id", "epoch_id", "channel", "t", *r("value"))


def erp_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.erp(_epochs(spark, sf_dir)).select("condition", "channel", "t", *r("value"))


def erp_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = ep.channel_mean(ep.erp(_epochs(spark, sf_dir)), [0, 1, 2, 3])
    return ep.peak(wave, 2, 20).select("condition", "latency", *r("amplitude", "mean", "auc"))


def mean_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = ep.channel_mean(ep.erp(_epochs(spark, sf_dir)))
    return ep.mean_amplitude(wave, {"early": (0, 9), "late": (10, 25)}).select("condition", *r("early", "late"))


def difference_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.difference_wave(ep.channel_mean(ep.erp(_epochs(spark, sf_dir))), 0, 1).select("t", *r("difference"))


def gfp_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    gfp = ep.global_field_power(ep.erp(_epochs(spark, sf_dir)))
    return gfp.groupBy("condition").agg(F.max_by("t", F.struct("gfp", -F.col("t"))).alias("t"), F.round(F.max("gfp"), 6).alias("gfp"))


def bad_var_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.bad_by_variance(signal_long(spark, sf_dir), 2.0).select("rec_id", "channel", *r("variance", "z"), "bad")


def bad_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.bad_by_deviation(signal_long(spark, sf_dir), 2.0).select("rec_id", "channel", *r("deviation", "z"), "bad")


def high_var_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.high_variance(signal_long(spark, sf_dir), 2.0).select("rec_id", "channel", *r("variance", "z"), "bad")


def rereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.rereference(signal_long(spark, sf_dir), [0, 1, 2]).select("rec_id", "sample_idx", "channel", *r("value"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.correlation_edges(recordings(spark, sf_dir), "rec_id")


def corr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("rec_id", "roi_i", "roi_j", *r("weight"))


def spearman_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.spearman_edges(signal_long(spark, sf_dir), "rec_id", "channel", "sample_idx", "value", 64).select("rec_id", "roi_i", "roi_j", *r("weight"))


def bad_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.bad_by_correlation(_edges(spark, sf_dir), 0.05).select("rec_id", "channel", *r("median_corr"), "bad")


def bridged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter(F.abs("weight") > 0.15).select("rec_id", "roi_i", "roi_j", *r("weight"))


def corr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.correlation_summary(_edges(spark, sf_dir), "rec_id").select("rec_id", *r("mean"), "n_high", "n_low")


def trial_conn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.trial_stats(_edges(spark, sf_dir), []).select("roi_i", "roi_j", *r("mean", "std", "variance"))


def network_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    atlas = spark.range(64).select(F.col("id").cast("int").alias("roi"), F.concat(F.lit("net"), (F.col("id") % 8).cast("string")).alias("network"))
    return cn.network_means(_edges(spark, sf_dir), atlas, ["rec_id"]).select("rec_id", "network_a", "network_b", *r("mean"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.graph_metrics(_edges(spark, sf_dir), "rec_id", 1.0).select("rec_id", *r("threshold", "mean_degree", "std_degree", "mean_strength", "clustering"))


def top_edges_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cn.trial_stats(_edges(spark, sf_dir), [])
    return stats.orderBy(F.desc("variance"), "roi_i", "roi_j").limit(5).select("roi_i", "roi_j", *r("variance"))


def edge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.threshold_edges(_edges(spark, sf_dir), 0.05).groupBy("rec_id").agg(F.count_if(F.col("weight") != 0).alias("n_kept"), F.round(F.sum("weight"), 6).alias("total"))


def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signal_long(spark, sf_dir).groupBy("rec_id").agg(*distribution("value"))
    return df.select("rec_id", "n", *r("mean", "median", "std", "min", "max", "p95", "p99"))


def knn_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    montage = spark.range(64).select(F.col("id").cast("int").alias("channel"), (F.col("id") % 8).cast("double").alias("x"), F.floor(F.col("id") / 8).cast("double").alias("y"), F.lit(0.0).alias("z"))
    near = qc.neighbours(montage, 6)
    bad = qc.bad_by_variance(signal_long(spark, sf_dir), 1.0).filter("bad").select("rec_id", "channel")
    return qc.clustered_bad(near, bad, 6)


def channel_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signal_long(spark, sf_dir).filter("channel % 5 <> rec_id % 5").select("rec_id", "channel").distinct()
    return qc.common_channels(df)


def run_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = signal_long(spark, sf_dir).groupBy("rec_id").agg((F.count_distinct("sample_idx") / SFREQ).alias("duration"))
    return qc.concatenate(runs.withColumn("subject", F.lit(1)), ["subject"], ["rec_id"], "duration").select("rec_id", *r("duration", "offset"))


NAMES = """tumble_flat hop_variance hop_ptp amplitude_islands gradient_islands muscle_islands band_level flatline_windows good_samples rms_tumble artifact_density epoch_range_join
epoch_bad_antijoin epoch_ptp_reject baseline_correct detrended erp_mean erp_peak mean_amplitude difference_wave gfp_peak bad_var_mad bad_deviation high_var_iqr
rereference corr_edges spearman_edges bad_corr bridged_pairs corr_summary trial_conn_stats network_means graph_degree top_edges_var edge_threshold distribution_stats
knn_cluster channel_intersection run_concat"""
QUERIES = {name: globals()[name] for name in NAMES.split()}

SIG = """sig AS (SELECT vec_id // 250 AS rec_id, vec_id % 250 AS sample_idx, label AS condition, generate_subscripts(embedding, 1) - 1 AS channel, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
  len AS (SELECT rec_id, max(sample_idx) + 1 AS n FROM sig GROUP BY 1)"""


def _hop(width: int, step: int, where: str = "true") -> str:
    return f"""hop AS (SELECT s.rec_id, channel, k * {step} AS wstart, value FROM sig s JOIN len USING (rec_id), LATERAL (SELECT unnest(range(0, n, {step})) // {step} AS k) w
      WHERE {where} AND sample_idx >= k * {step} AND sample_idx < k * {step} + {width} AND k * {step} + {width} <= n)"""


def _islands(mask: str, least: float, sfreq: float = SFREQ) -> str:
    return f"""mask AS ({mask}), run AS (SELECT rec_id, sample_idx, sample_idx - row_number() OVER (PARTITION BY rec_id ORDER BY sample_idx) AS g FROM mask),
      isl AS (SELECT rec_id, min(sample_idx) / {sfreq}::DOUBLE AS onset, count(*) / {sfreq}::DOUBLE AS duration FROM run GROUP BY rec_id, g HAVING count(*) / {sfreq}::DOUBLE >= {least})"""


def _gradient(limit: float) -> str:
    return f"SELECT DISTINCT rec_id, sample_idx FROM (SELECT *, abs(lead(value) OVER (PARTITION BY rec_id, channel ORDER BY sample_idx) - value) AS d FROM sig) WHERE d > {limit}"


CONV = f"""taps AS (SELECT unnest(range(0, {len(MUSCLE)})) - {len(MUSCLE) // 2} AS o, unnest({MUSCLE}) AS h), place AS (SELECT s.rec_id, channel, sample_idx, h, n, sample_idx - o AS q FROM sig s JOIN len USING (rec_id), taps),
  conv AS (SELECT p.rec_id, p.channel, p.sample_idx, sum(h * x.value) AS value FROM place p JOIN sig x ON x.rec_id = p.rec_id AND x.channel = p.channel AND x.sample_idx = CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END GROUP BY 1, 2, 3),
  power AS (SELECT rec_id, sample_idx, avg(abs(value)) AS p FROM conv GROUP BY 1, 2), muscle AS (SELECT rec_id, sample_idx FROM (SELECT *, (p - avg(p) OVER w) / stddev_pop(p) OVER w AS z FROM power WINDOW w AS (PARTITION BY rec_id)) WHERE z > {Z_MUSCLE})"""


EV = f"""ev AS (SELECT vec_id // 250 AS rec_id, (vec_id % 250) // {EVERY} AS epoch_id, vec_id % 250 AS sample, label % 3 AS condition FROM embeddings WHERE (vec_id % 250) % {EVERY} = {BEFORE} AND vec_id % 250 + {AFTER} < 250),
  epo AS (SELECT s.rec_id, epoch_id, ev.condition, channel, CAST(sample_idx - sample AS INT) AS t, value FROM sig s JOIN ev ON s.rec_id = ev.rec_id AND sample_idx BETWEEN sample - {BEFORE} AND sample + {AFTER}),
  erp AS (SELECT condition, channel, t, avg(value) AS value FROM epo GROUP BY ALL)"""
EPO = f"{SIG}, {EV}"
EDGE = f"""{SIG}, edge AS (SELECT a.rec_id, a.channel AS roi_i, b.channel AS roi_j, corr(a.value, b.value) AS weight FROM sig a JOIN sig b ON a.rec_id = b.rec_id AND a.sample_idx = b.sample_idx AND a.channel < b.channel GROUP BY ALL),
  full_ AS (SELECT rec_id, roi_i, roi_j, weight FROM edge UNION ALL SELECT rec_id, roi_j, roi_i, weight FROM edge)"""
STATS = "st AS (SELECT roi_i, roi_j, avg(weight) AS mean, stddev_pop(weight) AS std, var_pop(weight) AS variance FROM edge GROUP BY ALL)"


def _mad(column: str, source: str, limit: float) -> str:
    return f"""{SIG}, {source}, med AS (SELECT rec_id, quantile_cont({column}, 0.5) AS m FROM src GROUP BY 1), dev AS (SELECT src.*, m, abs({column} - m) AS d FROM src JOIN med USING (rec_id)),
      mad AS (SELECT rec_id, quantile_cont(d, 0.5) AS mad FROM dev GROUP BY 1), zed AS (SELECT rec_id, channel, {column}, abs({column} - m) / (1.4826::DOUBLE * mad + 1e-10) AS z FROM dev JOIN mad USING (rec_id))
      SELECT rec_id, channel, round({column}, 6) AS {column}, round(z, 6) AS z, z > {limit} AS bad FROM zed"""


VAR = "src AS (SELECT rec_id, channel, var_pop(value) AS variance FROM sig GROUP BY ALL)"
MONTAGE = """mon AS (SELECT CAST(i AS INT) AS channel, i % 8 AS x, i // 8 AS y FROM range(64) t(i)), near AS (SELECT a.channel, b.channel AS other FROM mon a JOIN mon b ON a.channel <> b.channel
  QUALIFY row_number() OVER (PARTITION BY a.channel ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.channel) <= 6)"""

ORACLE = {
    "tumble_flat": f"""WITH {SIG}, t AS (SELECT s.rec_id, channel, sample_idx // 25 * 25 AS w, stddev_pop(value) AS sd FROM sig s JOIN len USING (rec_id) WHERE sample_idx // 25 * 25 < n - 25 GROUP BY ALL)
      SELECT rec_id, channel, bool_or(sd < 0.08) AS flat, round(min(sd), 6) AS min_std FROM t GROUP BY 1, 2""",
    "hop_variance": f"WITH {SIG}, {_hop(20, 10)}, v AS (SELECT rec_id, channel, var_pop(value) AS v FROM hop GROUP BY rec_id, channel, wstart) SELECT rec_id, channel, bool_or(v < 0.005) AS flat, round(min(v), 6) AS min_var FROM v GROUP BY 1, 2",
    "hop_ptp": f"""WITH {SIG}, {_hop(25, 12)}, p AS (SELECT rec_id, max(value) - min(value) AS p FROM hop GROUP BY rec_id, channel, wstart)
      SELECT rec_id, count(*) AS n, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.9), 6) AS p90, round(quantile_cont(p, 0.95), 6) AS p95 FROM p GROUP BY 1""",
    "amplitude_islands": f"""WITH {SIG}, {_hop(20, 10)}, bad AS (SELECT DISTINCT rec_id, wstart FROM (SELECT rec_id, wstart, channel FROM hop GROUP BY ALL HAVING max(value) - min(value) > {AMPLITUDE})),
      {_islands('SELECT DISTINCT rec_id, unnest(range(wstart, wstart + 20)) AS sample_idx FROM bad', 0.1)} SELECT rec_id, round(onset, 6) AS onset, round(duration, 6) AS duration FROM isl""",
    "gradient_islands": f"WITH {SIG}, {_islands(_gradient(GRADIENT), 0.008)} SELECT rec_id, round(onset, 6) AS onset, round(duration, 6) AS duration FROM isl",
    "muscle_islands": f"WITH {SIG}, {CONV}, {_islands('SELECT * FROM muscle', 0.004)} SELECT rec_id, round(onset, 6) AS onset, round(duration, 6) AS duration FROM isl",
    "band_level": f"WITH {SIG}, {CONV} SELECT rec_id, CAST(channel AS INT) AS channel, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak FROM conv GROUP BY 1, 2",
    "flatline_windows": f"""WITH {SIG}, {_hop(25, 25)}, v AS (SELECT rec_id, wstart, channel, var_pop(value) AS v FROM hop GROUP BY ALL)
      SELECT rec_id, wstart, count(*) FILTER (v < 0.011) AS n_flat FROM v GROUP BY 1, 2 HAVING count(*) FILTER (v < 0.011) >= greatest(1, floor(count(*) * 0.1))""",
    "good_samples": f"""WITH {SIG}, mask AS ({_gradient(GRADIENT)}) SELECT rec_id, channel, count(*) AS n, round(avg(value), 6) AS mean FROM sig s WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.rec_id = s.rec_id AND m.sample_idx = s.sample_idx) GROUP BY 1, 2""",
    "rms_tumble": f"WITH {SIG} SELECT rec_id, sample_idx // 50 AS \"window\", round(sqrt(avg(value * value)), 6) AS rms FROM sig GROUP BY 1, 2",
    "artifact_density": f"""WITH {SIG}, {_hop(20, 10)}, p AS (SELECT rec_id, wstart, max(value) - min(value) AS p FROM hop GROUP BY rec_id, channel, wstart), t AS (SELECT rec_id, quantile_cont(p, 0.95) AS t FROM p GROUP BY 1)
      SELECT rec_id, wstart // 100 AS bin, count(*) FILTER (p > t) AS n_above, round(count(*) FILTER (p > t) / least(100, n - wstart // 100 * 100), 6) AS density FROM p JOIN t USING (rec_id) JOIN len USING (rec_id) GROUP BY rec_id, wstart // 100, n""",
    "epoch_range_join": f"WITH {EPO} SELECT rec_id, epoch_id, condition, count(*) AS n, min(t) AS t0, round(sum(value), 6) AS total FROM epo GROUP BY 1, 2, 3",
    "epoch_bad_antijoin": f"""WITH {EPO}, {_islands(_gradient(STEEP), 0.0, 1.0)} SELECT rec_id, epoch_id, sample - {BEFORE} AS start, sample + {AFTER + 1} AS stop FROM ev
      WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.rec_id = ev.rec_id AND onset < sample + {AFTER + 1} AND onset + duration > sample - {BEFORE})""",
    "epoch_ptp_reject": f"""WITH {EPO}, p AS (SELECT rec_id, epoch_id, max(value) - min(value) AS p FROM epo GROUP BY rec_id, epoch_id, channel)
      SELECT rec_id, epoch_id, round(max(p), 6) AS max_ptp, round(min(p), 6) AS min_ptp, max(p) > 0.8 OR min(p) < 0.3 AS dropped FROM p GROUP BY 1, 2""",
    "baseline_correct": f"""WITH {EPO}, b AS (SELECT rec_id, epoch_id, channel, t, value - avg(value) FILTER (t BETWEEN -{BEFORE} AND -1) OVER (PARTITION BY rec_id, epoch_id, channel) AS value FROM epo)
      SELECT rec_id, epoch_id, channel, t, round(value, 6) AS value FROM b""",
    "detrended": f"""WITH {EPO}, l AS (SELECT rec_id, epoch_id, channel, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM epo GROUP BY ALL)
      SELECT rec_id, epoch_id, channel, t, round(value - a * t - b, 6) AS value FROM epo JOIN l USING (rec_id, epoch_id, channel)""",
    "erp_mean": f"WITH {EPO} SELECT condition, channel, t, round(value, 6) AS value FROM erp",
    "erp_peak": f"""WITH {EPO}, w AS (SELECT condition, t, avg(value) AS v FROM erp WHERE channel < 4 GROUP BY ALL), i AS (SELECT *, (v + lag(v) OVER (PARTITION BY condition ORDER BY t)) / 2 AS mid, t - lag(t) OVER (PARTITION BY condition ORDER BY t) AS dt FROM w WHERE t BETWEEN 2 AND 20)
      SELECT condition, arg_max(t, (v, -t)) AS latency, round(max(v), 6) AS amplitude, round(avg(v), 6) AS mean, round(sum(mid) * avg(dt), 6) AS auc FROM i GROUP BY 1""",
    "mean_amplitude": f"WITH {EPO}, w AS (SELECT condition, t, avg(value) AS v FROM erp GROUP BY ALL) SELECT condition, round(avg(v) FILTER (t BETWEEN 0 AND 9), 6) AS early, round(avg(v) FILTER (t BETWEEN 10 AND 25), 6) AS late FROM w GROUP BY 1",
    "difference_wave": f"WITH {EPO}, w AS (SELECT condition, t, avg(value) AS v FROM erp GROUP BY ALL) SELECT t, round(avg(v) FILTER (condition = 0) - avg(v) FILTER (condition = 1), 6) AS difference FROM w GROUP BY 1",
    "gfp_peak": f"WITH {EPO}, g AS (SELECT condition, t, stddev_pop(value) AS g FROM erp GROUP BY ALL) SELECT condition, arg_max(t, (g, -t)) AS t, round(max(g), 6) AS gfp FROM g GROUP BY 1",
    "bad_var_mad": f"WITH {_mad('variance', VAR, 2.0)}",
    "bad_deviation": f"WITH {_mad('deviation', 'cm AS (SELECT rec_id, sample_idx, quantile_cont(value, 0.5) AS c FROM sig GROUP BY ALL), src AS (SELECT rec_id, channel, avg((value - c) * (value - c)) AS deviation FROM sig JOIN cm USING (rec_id, sample_idx) GROUP BY ALL)', 2.0)}",
    "high_var_iqr": f"""WITH {SIG}, {VAR}, q AS (SELECT rec_id, quantile_cont(variance, 0.25) AS a, quantile_cont(variance, 0.5) AS m, quantile_cont(variance, 0.75) AS b FROM src GROUP BY 1),
      z AS (SELECT rec_id, channel, variance, CASE WHEN b - a >= 1e-10 THEN (variance - m) / (0.7413::DOUBLE * (b - a)) END AS z FROM src JOIN q USING (rec_id)) SELECT rec_id, channel, round(variance, 6) AS variance, round(z, 6) AS z, coalesce(z > 2.0, false) AS bad FROM z""",
    "rereference": f"""WITH {SIG}, m AS (SELECT rec_id, sample_idx, avg(value) AS m FROM sig WHERE channel IN (0, 1, 2) GROUP BY ALL) SELECT rec_id, sample_idx, channel, round(value - m, 6) AS value FROM sig JOIN m USING (rec_id, sample_idx)""",
    "corr_edges": f"WITH {EDGE} SELECT rec_id, roi_i, roi_j, round(weight, 6) AS weight FROM edge",
    "spearman_edges": f"""WITH {SIG}, rk AS (SELECT rec_id, channel, sample_idx, rank() OVER (PARTITION BY rec_id, channel ORDER BY value) + (count(*) OVER (PARTITION BY rec_id, channel, value) - 1) / 2 AS r FROM sig)
      SELECT a.rec_id, a.channel AS roi_i, b.channel AS roi_j, round(corr(a.r, b.r), 6) AS weight FROM rk a JOIN rk b ON a.rec_id = b.rec_id AND a.sample_idx = b.sample_idx AND a.channel < b.channel GROUP BY 1, 2, 3""",
    "bad_corr": f"""WITH {EDGE}, f AS (SELECT rec_id, roi_i AS channel, abs(coalesce(weight, 0)) AS w FROM full_ UNION ALL SELECT DISTINCT rec_id, roi_i, 1.0 FROM full_)
      SELECT rec_id, channel, round(quantile_cont(w, 0.5), 6) AS median_corr, quantile_cont(w, 0.5) < 0.05 AS bad FROM f GROUP BY 1, 2""",
    "bridged_pairs": f"WITH {EDGE} SELECT rec_id, roi_i, roi_j, round(weight, 6) AS weight FROM edge WHERE abs(weight) > 0.15",
    "corr_summary": f"WITH {EDGE} SELECT rec_id, round(avg(coalesce(weight, 0)), 6) AS mean, count(*) FILTER (abs(weight) > 0.95) AS n_high, count(*) FILTER (abs(coalesce(weight, 0)) < 0.1) AS n_low FROM edge GROUP BY 1",
    "trial_conn_stats": f"WITH {EDGE}, {STATS} SELECT roi_i, roi_j, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance FROM st",
    "network_means": f"""WITH {EDGE} SELECT rec_id, least('net' || roi_i % 8, 'net' || roi_j % 8) AS network_a, greatest('net' || roi_i % 8, 'net' || roi_j % 8) AS network_b, round(avg(weight), 6) AS mean FROM edge GROUP BY 1, 2, 3""",
    "graph_degree": f"""WITH {EDGE}, f AS (SELECT * FROM full_), c AS (SELECT rec_id, coalesce(quantile_cont(weight, 0.5) FILTER (weight > 0), 0) AS th FROM f GROUP BY 1),
      j AS (SELECT f.*, th, weight > th AS up FROM f JOIN c USING (rec_id)), n AS (SELECT rec_id, roi_i, th, count(*) FILTER (up) AS d, sum(weight) + 1 AS s FROM j GROUP BY ALL),
      l AS (SELECT rec_id, roi_i AS a, roi_j AS b FROM j WHERE up), tri AS (SELECT x.rec_id, x.a AS roi_i, count(*) AS t FROM l x JOIN l y ON x.rec_id = y.rec_id AND x.b = y.a AND x.a <> y.b JOIN l z ON z.rec_id = x.rec_id AND z.a = x.a AND z.b = y.b GROUP BY 1, 2)
      SELECT rec_id, round(th, 6) AS threshold, round(avg(d + (1 > th)::INT), 6) AS mean_degree, round(stddev_pop(d + (1 > th)::INT), 6) AS std_degree, round(avg(s), 6) AS mean_strength, round(avg(coalesce(coalesce(t, 0) / nullif(d * (d - 1), 0), 0)), 6) AS clustering
      FROM n LEFT JOIN tri USING (rec_id, roi_i) GROUP BY rec_id, th""",
    "top_edges_var": f"WITH {EDGE}, {STATS} SELECT roi_i, roi_j, round(variance, 6) AS variance FROM (SELECT * FROM st ORDER BY variance DESC, roi_i, roi_j LIMIT 5)",
    "edge_threshold": f"WITH {EDGE} SELECT rec_id, count(*) FILTER (abs(weight) >= 0.05) AS n_kept, round(sum(CASE WHEN abs(weight) >= 0.05 THEN weight ELSE 0 END), 6) AS total FROM edge GROUP BY 1",
    "distribution_stats": f"""WITH {SIG} SELECT rec_id, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
      round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM sig GROUP BY 1""",
    "knn_cluster": f"""WITH {MONTAGE}, z AS (WITH {_mad('variance', VAR, 1.0)}), bad AS (SELECT rec_id, channel FROM z WHERE bad)
      SELECT b.rec_id, b.channel, count(o.channel) AS n_bad, count(o.channel) / 6 >= 0.5 AS clustered FROM bad b JOIN near USING (channel) LEFT JOIN bad o ON o.rec_id = b.rec_id AND o.channel = near.other GROUP BY 1, 2""",
    "channel_intersection": f"WITH {SIG}, c AS (SELECT DISTINCT rec_id, channel FROM sig WHERE channel % 5 <> rec_id % 5) SELECT channel FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT rec_id) FROM c)",
    "run_concat": f"""WITH {SIG} SELECT rec_id, round(n / {SFREQ}::DOUBLE, 6) AS duration, round(coalesce(sum(n / {SFREQ}::DOUBLE) OVER (ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM len""",
}
