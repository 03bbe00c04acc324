"""Runs and their processing steps: the same summary from a table of step records and from a stream of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from neurospan.sinks.store import StateTable

#: A step record.
RECORD = "run_id string, step_name string, status string, at timestamp, error string"
STEPS = "array<struct<at: timestamp, step_name: string, status: string, error: string>>"
STATE = "names array<string>, statuses array<string>, errors array<string>, times array<long>"


def _of(steps: Column, status: str) -> Column:
    return F.transform(F.filter(steps, lambda s: s["status"] == status), lambda s: s["step_name"])


def summarised(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_steps, completed, failed, status, error, updated_at from the steps of each run.

    Steps are in the order they were last written. A run has failed where a step has, is in progress where one is or is
    pending, and is completed otherwise; error is that of the last failed step.
    """
    steps = F.col("steps")
    has = lambda *what: F.exists(steps, lambda s: s["status"].isin(*what))
    last = F.try_element_at(F.filter(steps, lambda s: s["status"] == "failed"), F.lit(-1))
    return runs.select(
        *keys, F.size(steps).alias("n_steps"), _of(steps, "completed").alias("completed"), _of(steps, "failed").alias("failed"),
        F.when(has("failed"), "failed").when(has("in_progress", "pending"), "in_progress").otherwise("completed").alias("status"),
        last["error"].alias("error"), F.array_max(F.transform(steps, lambda s: s["at"])).alias("updated_at"))


def latest_steps(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys and steps: of each step of a run the last record, in the order of time, then name.

    Of records of one step and time the greatest by status and error counts. Maxima of each task go
    to the shuffle, so a step written over and over costs one row a task. Records without a run, step or time fall out.
    """
    known = records.dropna(subset=[*keys, "step_name", "at"])
    one = known.groupBy(*keys, "step_name").agg(F.max(F.struct("at", "status", "error")).alias("_l"))
    step = F.struct("_l.at", "step_name", "_l.status", "_l.error").cast("struct<at: timestamp, step_name: string, status: string, error: string>")
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def run_states(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The summary of each run in a table of step records."""
    keys = keys or ["run_id"]
    return summarised(latest_steps(records, keys), keys)


def read_records(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Step records that arrive as JSON files in a folder, as a stream."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_at_once).json(path)


def _merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The steps of one run after more records; as many as the run has steps are held."""
    if state.hasTimedOut:
        state.remove()
        return
    steps: dict[str, tuple[int, str, str | None]] = {}
    order = lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or "")
    if state.exists:
        names, statuses, errors, times = state.get
        steps = {n: (t, s, e) for n, s, e, t in zip(names, statuses, errors, times, strict=True)}
    for frame in frames:
        micros = frame["at"].astype("datetime64[us]").astype("int64")
        for name, status, error, at in zip(frame["step_name"], frame["status"], frame["error"], micros, strict=True):
            new = (int(at), None if pd.isna(status) else status, None if pd.isna(error) else error)
            if name not in steps or order(new) > order(steps[name]):
                steps[name] = new
    rows = sorted(steps.items(), key=lambda x: (x[1][0], x[0]))
    state.update(([n for n, _ in rows], [x[1] for _, x in rows], [x[2] for _, x in rows], [x[0] for _, x in rows]))
    yield pd.DataFrame({"run_id": [key[0]], "names": [[n for n, _ in rows]], "statuses": [[x[1] for _, x in rows]], "errors": [[x[2] for _, x in rows]], "times": [[x[0] for _, x in rows]]})


def stream_states(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """run_id and steps of each run that got records, after each micro-batch.

    State is kept by run: the last record of each of its steps. A record older than the watermark, late
    behind the newest record of the batches before, is dropped, so a run's state is bounded by its
    steps and what is dropped doesn't depend on the order inside a batch.
    """
    known = records.dropna(subset=["run_id", "step_name", "at"]).withWatermark("at", late)
    out = known.groupBy("run_id").applyInPandasWithState(_merge, f"run_id string, {STATE}", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    parts = F.arrays_zip("times", "names", "statuses", "errors")
    step = lambda x: F.struct(F.timestamp_micros(x["times"]), x["names"], x["statuses"], x["errors"])
    return out.select("run_id", F.transform(parts, step).cast(STEPS).alias("steps"))


def follow(records: DataFrame, table: StateTable, checkpoint: str, late: str = "10 minutes", name: str = "runs", **trigger: Any) -> StreamingQuery:
    """Keeps a table of run summaries up to date with a stream of step records.

    Each micro-batch is one commit that also names the batch, so a batch that runs again after a failure
    changes nothing; a commit of another writer in between makes the batch start again on top of it.
    """
    def put(batch: DataFrame, number: int) -> None:
        rows = summarised(batch, ["run_id"])
        table.change(lambda t, version: t.upsert(rows, version, order="updated_at", stream=(name, number)))

    writer = stream_states(records, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
