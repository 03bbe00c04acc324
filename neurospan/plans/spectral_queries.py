"""Queries whose numbers come from array kernels; SQL can't express them, tests hold them to identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions import kernels as kn
from neurospan.operators import epochs as ep
from neurospan.operators import spectral as sp
from neurospan.sources.tables import recordings

SFREQ = 250.0
N = 12


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channels of each recording: 250 samples don't determine an autoregression of all 64."""
    return recordings(spark, sf_dir).withColumn("values", F.slice("values", 1, N))


def phase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.phase_edges(recordings(spark, sf_dir), 8.0, 13.0, SFREQ)


def envelope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.envelope_edges(recordings(spark, sf_dir), 8.0, 13.0, SFREQ)


def coherence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.coherence_edges(recordings(spark, sf_dir), 8.0, 13.0, SFREQ, 64)


def partial_corr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.partial_edges(recordings(spark, sf_dir))


def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.directed_edges(_few(spark, sf_dir), 8.0, 13.0, SFREQ, 4)


def morlet_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.power(recordings(spark, sf_dir), [8.0, 10.0, 13.0, 20.0], SFREQ, 10)


def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in (("alpha", 8.0, 13.0), ("beta", 13.0, 30.0))])
    return ep.band_means(morlet_power(spark, sf_dir), bands)


def fir_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = kn.fir(1.0, 40.0, SFREQ, 101)
    return sp.transform(recordings(spark, sf_dir), lambda x: kn.apply_fir(h, x))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.transform(recordings(spark, sf_dir), lambda x: kn.resample(x, SFREQ, 100.0))


def line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.channel_table(recordings(spark, sf_dir), lambda x: kn.line_noise_ratio(x, SFREQ), "ratio")


def rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.quality(recordings(spark, sf_dir))


def ica_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.components(recordings(spark, sf_dir), 5)


QUERIES = {f.__name__: f for f in (phase_edges, envelope_edges, coherence_edges, partial_corr_edges, directed_edges, morlet_power, band_power, fir_filtered, resampled, line_noise, rank_quality, ica_sources)}
ORACLE: dict[str, str] = {}
