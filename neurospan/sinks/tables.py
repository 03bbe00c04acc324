"""Sinks: formatted event files, and tables that keep the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that come first in an events file.
EVENT_COLUMNS = ("onset", "duration", "trial_type", "response_time", "accuracy")


def _formatted(df: DataFrame, names: list[str]) -> list[Column]:
    columns = [c for c in EVENT_COLUMNS if c in names] + sorted(c for c in names if c not in EVENT_COLUMNS)
    kinds = dict(df.dtypes)
    text = lambda c: F.format_string("%.6f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    return [F.coalesce(F.when(F.col(c).isNotNull(), text(c)), F.lit("n/a")).alias(c) for c in columns]


def events_table(df: DataFrame) -> DataFrame:
    """Standard columns first, then the others sorted; floats with six digits, missing as n/a."""
    return df.select(*_formatted(df, df.columns))


def write_events(df: DataFrame, path: str) -> None:
    events_table(df).write.mode("overwrite").csv(path, sep="\t", header=True)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate with map-side maxima, no window over all versions."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same keys, nulls matching nulls; new's columns may add some."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_v"]).drop("_v")


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_sidecar(columns: DataFrame, used: list[str], path: str) -> None:
    """Descriptions (column, description) of the columns that an events file has, as JSON lines."""
    columns.filter(F.col("column").isin(used)).coalesce(1).write.mode("overwrite").json(path)  # a row a column


def write_records(df: DataFrame, path: str, *keys: str) -> None:
    """One JSON record a row, below a folder for each value of keys; missing fields are left out."""
    df.write.mode("overwrite").partitionBy(*keys).json(path) if keys else df.write.mode("overwrite").json(path)


def manifest(old: DataFrame, done: DataFrame) -> DataFrame:
    """subject_id, modules, updated: old's modules, then those done (subject_id, module, time) in time order, each once."""
    fresh = done.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("time", "module"))).alias("_new"), F.max("time").alias("_time"))
    both = old.join(fresh, "subject_id", "full")
    none = F.array().cast("array<string>")
    modules = F.array_distinct(F.concat(F.coalesce("modules", none), F.coalesce(F.col("_new.module"), none)))
    return both.select("subject_id", modules.alias("modules"), F.coalesce("_time", "updated").alias("updated"))


def participants(files: DataFrame) -> DataFrame:
    """participant_id of every subject of a listing, with the prefix sub-, once each."""
    bare = F.regexp_replace("subject", "^sub-", "")
    return files.select(F.concat(F.lit("sub-"), bare).alias("participant_id")).distinct()


def write_inclusion(df: DataFrame, path: str, included: str = "included") -> None:
    """The rows included as JSON records, and their subjects as text, one a line; a missing mark includes."""
    kept = df.filter(F.coalesce(F.col(included), F.lit(True)))
    kept.drop(included).write.mode("overwrite").json(f"{path}/records")
    kept.select(F.col("subject").cast("string")).distinct().write.mode("overwrite").text(f"{path}/subjects")


def write_runs(trials: DataFrame, columns: DataFrame, path: str, run: str, order: tuple[str, ...] = ("onset",)) -> None:
    """The behavioural files of all runs at once: events, their sidecar and the detailed trials, a folder for each run.

    trials has a column run that names the folder; columns (column, description) describes what an events file may
    hold, and the sidecar keeps what it does. Trials without a run aren't written; without any nothing is. A run's rows go to
    one task, in order, so a run is one file.
    """
    named = trials.filter(F.col(run).isNotNull())
    if named.isEmpty():
        return
    together = named.repartition(run).sortWithinPartitions(run, *order)
    _with_run(together, run).write.mode("overwrite").partitionBy(run).csv(f"{path}/events", sep="\t", header=True)
    write_sidecar(columns, [c for c in trials.columns if c != run], f"{path}/sidecar")
    together.write.mode("overwrite").partitionBy(run).csv(f"{path}/trials", sep="\t", header=True, nullValue="n/a")


def write_triggers(events: DataFrame, path: str, run: str, sfreq: float, sample: str = "sample", code: str = "code") -> None:
    """Events files of runs that have triggers only: onset, duration 0, the type trigger and the code as value."""
    rows = events.filter(F.col(run).isNotNull()).select(run, (F.col(sample) / sfreq).alias("onset"), F.lit(0).alias("duration"), F.lit("trigger").alias("trial_type"), F.col(code).cast("string").alias("value"))
    if not rows.isEmpty():
        _with_run(rows.repartition(run).sortWithinPartitions(run, "onset"), run).write.mode("overwrite").partitionBy(run).csv(f"{path}/events", sep="\t", header=True)


def _with_run(df: DataFrame, run: str) -> DataFrame:
    """Columns of an events file as text, and the run's as it is, so rows stay in the order they have in it."""
    return df.select(*_formatted(df, [c for c in df.columns if c != run]), run)
