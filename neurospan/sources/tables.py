"""Adapters from the driver's tables to the domain tables (trials, long signals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(column: str) -> F.Column:
    """NaN sorts above every number in Spark; missing values are NULL from here on."""
    return F.nullif(F.col(column), F.lit(float("nan"))).alias(column)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a trial table; trial_idx carries the row order inside a subject."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    code = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        F.row_number().over(order).cast("long").alias("trial_idx"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("onset"),
        F.col("event_type").alias("trial_type"),
        (F.nullif(F.col("value"), F.lit(float("nan"))) / 100).alias("response_time"),
        F.pmod(code, F.lit(2)).cast("double").alias("accuracy"),
        code.alias("code"),
    )


SAMPLES = 250


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as recordings of 250 samples, one row for a sample: rec_id, sample_idx, condition, values."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / SAMPLES).alias("rec_id"),
        F.pmod(F.col("vec_id"), F.lit(SAMPLES)).alias("sample_idx"),
        F.col("label").alias("condition"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def signal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one row for a sample and channel; NaN becomes NULL."""
    return recordings(spark, sf_dir).select(
        "rec_id", "sample_idx", "condition", F.posexplode("values").alias("channel", "value")
    ).withColumn("value", F.nullif("value", F.lit(float("nan"))))
