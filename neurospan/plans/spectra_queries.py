"""Queries over Welch spectra in segments of 100 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions.kernels import fir, wavelet
from neurospan.operators import spectra as se
from neurospan.operators import windows as wi
from neurospan.plans.signal_queries import REC, SFREQ, SIG
from neurospan.sources.tables import signal_long

SIZE = 100
BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
LOW, HIGH = 8.0, 30.0
KEYS = ["rec_id", "channel"]
FREQS = (30.0, 45.0)
FILTERS = {"low": fir(None, 40.0, SFREQ, 61).tolist(), "high": fir(20.0, None, SFREQ, 61).tolist()}


def r(*columns: str, digits: int = 5) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.density(se.transformed(signal_long(spark, sf_dir), *REC, SIZE, 0, SIZE // 2), KEYS, SIZE, SFREQ)


def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of every channel and frequency in decibels; the mean's own bin is left out."""
    return _density(spark, sf_dir).filter("bin > 0").select("rec_id", "channel", *r("frequency"), F.round(10 * F.log10("psd"), 5).alias("db"))


def welch_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _density(spark, sf_dir).withColumn("psd", F.col("psd") * 1e4)
    return se.band_power(scaled, KEYS, BANDS).select("rec_id", "channel", *r(*BANDS))


def welch_line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.line_ratio(_density(spark, sf_dir), KEYS).select("rec_id", "channel", *r("ratio"))


def welch_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of all pairs of channels between 8 and 30 Hz."""
    spectra = se.transformed(signal_long(spark, sf_dir), *REC, SIZE, *se.bins(SIZE, SFREQ, LOW, HIGH))
    return se.coherence(spectra, "rec_id", "channel").select("rec_id", "roi_i", "roi_j", *r("coherence", "icoh"))


def wavelet_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power under wavelets of 30 and 45 Hz."""
    power = se.wavelet_power(signal_long(spark, sf_dir), *REC, list(FREQS), SFREQ)
    return power.groupBy("rec_id", "channel", "frequency").agg(F.round(F.avg("power"), 6).alias("power"), F.round(F.max("power"), 6).alias("peak"))


def fir_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a low-pass and a high-pass filter leave of every channel."""
    y = wi.convolved_with(signal_long(spark, sf_dir), *REC, FILTERS)
    return y.groupBy("rec_id", "channel").agg(*[F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6).alias(c) for c in FILTERS])


QUERIES = {f.__name__: f for f in (welch_psd, welch_band_power, welch_line_noise, welch_coherence, wavelet_native, fir_native)}

SPECTRA = f"""{SIG}, seg AS (SELECT rec_id, CAST(channel AS INT) AS channel, k * {SIZE // 2} AS w, sample_idx - k * {SIZE // 2} AS t, value FROM sig JOIN len USING (rec_id), LATERAL (SELECT unnest(range(0, n, {SIZE // 2})) // {SIZE // 2} AS k) x WHERE sample_idx >= k * {SIZE // 2} AND sample_idx < k * {SIZE // 2} + {SIZE} AND k * {SIZE // 2} + {SIZE} <= n),
  win AS (SELECT rec_id, channel, w, t, (value - avg(value) OVER (PARTITION BY rec_id, channel, w)) * (0.5 - 0.5 * cos(2 * pi() * t / {SIZE})) AS v FROM seg),
  z AS (SELECT rec_id, channel, w, b, sum(v * cos(2 * pi() * b * t / {SIZE})) AS re, -sum(v * sin(2 * pi() * b * t / {SIZE})) AS im FROM win, range({{}}, {{}}) f(b) GROUP BY ALL)"""
PSD = f"""{SPECTRA.format(0, SIZE // 2 + 1)}, psd AS (SELECT rec_id, channel, b, b * {SFREQ} / {SIZE} AS f, avg(re * re + im * im) * CASE WHEN b IN (0, {SIZE // 2}) THEN 1 ELSE 2 END / ({SFREQ} * 0.375 * {SIZE}) AS p FROM z GROUP BY 1, 2, 3)"""

ORACLE = {
    "welch_psd": f"WITH {PSD} SELECT rec_id, channel, round(CAST(f AS DOUBLE), 5) AS frequency, round(10 * log10(p), 5) AS db FROM psd WHERE b > 0",
    "welch_band_power": f"WITH {PSD} SELECT rec_id, channel, " + ", ".join(f"round(avg(p * 1e4) FILTER (f >= {a} AND f < {z}), 5) AS {name}" for name, (a, z) in BANDS.items()) + " FROM psd GROUP BY 1, 2",
    "welch_line_noise": f"WITH {PSD} SELECT rec_id, channel, round(avg(p) FILTER (abs(f - 50) <= 2) / avg(p) FILTER (abs(f - 50) > 2 AND abs(f - 50) <= 10), 5) AS ratio FROM psd GROUP BY 1, 2",
    "welch_coherence": f"""WITH {SPECTRA.format(se.bins(SIZE, SFREQ, LOW, HIGH)[0], se.bins(SIZE, SFREQ, LOW, HIGH)[1] + 1)}, c AS (SELECT a.rec_id, a.channel AS roi_i, b.channel AS roi_j, a.b, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im, sum(a.re * a.re + a.im * a.im) AS x, sum(b.re * b.re + b.im * b.im) AS y
        FROM z a JOIN z b ON a.rec_id = b.rec_id AND a.w = b.w AND a.b = b.b AND a.channel < b.channel GROUP BY 1, 2, 3, 4)
      SELECT rec_id, roi_i, roi_j, round(avg((re * re + im * im) / (x * y)), 5) AS coherence, round(avg(abs(im) / sqrt(x * y)), 5) AS icoh FROM c GROUP BY 1, 2, 3""",
    "wavelet_native": f"WITH {SIG}, taps AS (" + " UNION ALL ".join(f"SELECT {f} AS f, unnest(range(0, {len(wavelet(f, SFREQ))})) - {len(wavelet(f, SFREQ)) // 2} AS o, unnest({wavelet(f, SFREQ).real.tolist()}) AS a, unnest({wavelet(f, SFREQ).imag.tolist()}) AS b" for f in FREQS) + """),
      z AS (SELECT rec_id, channel, sample_idx + o AS i, f, sum(a * value) AS re, sum(b * value) AS im FROM sig, taps GROUP BY 1, 2, 3, 4), p AS (SELECT rec_id, channel, f, re * re + im * im AS p FROM z JOIN len USING (rec_id) WHERE i >= 0 AND i < n)
      SELECT rec_id, CAST(channel AS INT) AS channel, CAST(f AS DOUBLE) AS frequency, round(avg(p), 6) AS power, round(max(p), 6) AS peak FROM p GROUP BY 1, 2, 3""",
    "fir_native": f"""WITH {SIG}, taps AS (SELECT unnest(range(0, 61)) - 30 AS o, unnest({FILTERS['low']}) AS a, unnest({FILTERS['high']}) AS b), place AS (SELECT s.rec_id, channel, sample_idx, a, b, n, sample_idx - o AS q FROM sig s JOIN len USING (rec_id), taps),
      z AS (SELECT p.rec_id, p.channel, p.sample_idx, sum(a * x.value) AS low, sum(b * x.value) AS high FROM place p JOIN sig x ON x.rec_id = p.rec_id AND x.channel = p.channel AND x.sample_idx = CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END GROUP BY 1, 2, 3)
      SELECT rec_id, CAST(channel AS INT) AS channel, round(sqrt(avg(low * low)), 6) AS low, round(sqrt(avg(high * high)), 6) AS high FROM z GROUP BY 1, 2""",
}
