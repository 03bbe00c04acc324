"""Queries over state tables: quality records imported, and the steps of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import state as st
from neurospan.scratch import new_folder
from neurospan.sinks.store import StateTable
from neurospan.sources.tables import table
from neurospan.streaming import runs

NOW = "2030-01-01 00:00:00"
QUALITIES = ("excellent", "good", "poor", "odd")


def _pick(k: F.Column, *names: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quality records: some names and some contents don't fit, some times can't be read."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    name = F.concat(text(F.col("o_custkey") % 400), F.lit("_ses-"), _pick(F.floor(k / 2), "01", "02", "x"), F.lit("_task-"), _pick(F.floor(k / 3), "rest", "odd"), F.lit("_run-"), text(k % 5), F.lit("_qc_metrics.json"))
    when = F.concat(F.lit("2024-01-"), F.lpad(text(k % 28 + 1), 2, "0"), F.lit("T10:00:00"))
    metrics = F.concat(F.lit('{"timestamp": "'), F.when(k % 6 == 0, "soon").otherwise(when), F.lit('", "quality_metrics": {"quality_status": "'), _pick(k, *QUALITIES), F.lit('", "n_bad_channels": '), text(k % 9), F.lit("}}"))
    content = F.when(k % 13 == 0, "{broken").when(k % 13 == 1, "[1, 2]").when(k % 13 == 2, '{"quality_metrics": 7}').when(k % 13 == 3, "{}").otherwise(metrics)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("/q/"), F.lpad(text(k), 9, "0"), F.lit("/"), name).alias("path"), content.alias("content"))


def _imported(spark: SparkSession, sf_dir: str) -> tuple[StateTable, DataFrame]:
    """A table of states that knows some runs, with the records imported."""
    store = StateTable(spark, new_folder(spark, "states"), st.RUN)
    known = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).cast("string").alias("subject_id")).distinct().filter("CAST(subject_id AS INT) % 3 = 0")
    store.replace(known.select("subject_id", F.lit("01").alias("session"), F.lit("rest").alias("task"), F.lit("1").alias("run"), F.lit("standard").alias("pipeline"), F.lit("failed").alias("status"), F.lit("2020-01-01").cast("timestamp").alias("created_at")))
    return store, st.import_quality(store, _records(spark, sf_dir), "standard", F.lit(NOW).cast("timestamp"))


def qc_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of states after the import; runs it knew before stay as they were."""
    step = F.col("steps")[0]
    field = lambda key: F.get_json_object(step["metadata"], f"$.{key}")
    return _imported(spark, sf_dir)[0].read().select(
        *st.RUN, "status", F.unix_micros("created_at").alias("created_us"), step["step_name"].alias("step_name"), step["output_path"].alias("output_path"),
        field("quality_status").alias("quality_status"), field("n_bad_channels").cast("long").alias("n_bad_channels"))


def qc_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.outcome_counts(_imported(spark, sf_dir)[1], "task", "problem")


STATUSES = ("completed", "completed", "failed", "in_progress", "completed", "skipped")


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as step records of their users: completed and failed steps in the order they were last written."""
    key = F.col("event_id")
    status = _pick(F.floor(key / 3), *STATUSES)
    records = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.concat("event_type", (key % 3).cast("string")).alias("step_name"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.when(status == "failed", F.concat(F.lit("e"), key.cast("string"))).alias("error"))
    out = runs.run_states(records)
    return out.select("run_id", F.col("n_steps").cast("long").alias("n_steps"), F.concat_ws(",", "completed").alias("completed"), F.concat_ws(",", "failed").alias("failed"), "status", "error", F.unix_micros("updated_at").alias("updated_us"))


QUERIES = {f.__name__: f for f in (qc_import, qc_import_counts, workflow_steps)}


def _of(key: str, *names: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} AS BIGINT) % {len(names)} + 1]"


FOUND = f"""k AS (SELECT o_orderkey AS k, CAST(o_custkey % 400 AS VARCHAR) AS subject_id, {_of('o_orderkey // 2', '01', '02', 'x')} AS session, {_of('o_orderkey // 3', 'rest', 'odd')} AS task, CAST(o_orderkey % 5 AS VARCHAR) AS run FROM orders),
  f AS (SELECT *, '/q/' || lpad(CAST(k AS VARCHAR), 9, '0') AS folder, CASE WHEN session = 'x' THEN 'name' WHEN k % 13 IN (0, 1) THEN 'content' WHEN k % 13 = 2 THEN 'metrics' END AS problem,
    CASE WHEN k % 13 = 3 OR k % 6 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 DAY * CAST(k % 28 AS INT) END AS t, CASE WHEN k % 13 = 3 THEN 'unknown' ELSE {_of('k', *QUALITIES)} END AS q, CASE WHEN k % 13 = 3 THEN 0 ELSE k % 9 END AS bad FROM k),
  known AS (SELECT DISTINCT CAST(c_custkey % 400 AS VARCHAR) AS subject_id FROM customer WHERE c_custkey % 400 % 3 = 0),
  o AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'failed' WHEN row_number() OVER (PARTITION BY subject_id, session, task, run, problem IS NULL ORDER BY folder) > 1 OR (session = '01' AND task = 'rest' AND run = '1' AND subject_id IN (FROM known)) THEN 'skipped' ELSE 'imported' END AS outcome FROM f)"""

ORACLE = {
    "qc_import": f"""WITH {FOUND} SELECT subject_id, session, task, run, 'standard' AS pipeline, 'completed' AS status, epoch_us(t) AS created_us, 'preprocessing_run' || run AS step_name, folder AS output_path, q AS quality_status, bad AS n_bad_channels FROM o WHERE outcome = 'imported'
      UNION ALL SELECT subject_id, '01', 'rest', '1', 'standard', 'failed', epoch_us(TIMESTAMP '2020-01-01'), NULL, NULL, NULL, NULL FROM known""",
    "qc_import_counts": f"""WITH {FOUND} SELECT CASE WHEN problem IS NULL OR problem <> 'name' THEN task END AS task, problem, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
      count(DISTINCT subject_id) FILTER (outcome = 'imported') AS n_subjects FROM o GROUP BY 1, 2""",
    "workflow_steps": f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type || (event_id % 3) AS step, {_of('event_id // 3', *STATUSES)} AS status, ts, event_id FROM events),
      x AS (SELECT *, CASE WHEN status = 'failed' THEN 'e' || event_id END AS error FROM r),
      l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY ts DESC, status DESC, error DESC NULLS LAST) = 1)
      SELECT run_id, count(*) AS n_steps, coalesce(string_agg(step, ',' ORDER BY ts, step) FILTER (status = 'completed'), '') AS completed, coalesce(string_agg(step, ',' ORDER BY ts, step) FILTER (status = 'failed'), '') AS failed,
        CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('in_progress', 'pending')) THEN 'in_progress' ELSE 'completed' END AS status, last(error ORDER BY ts, step) FILTER (status = 'failed') AS error, max(epoch_us(ts)) AS updated_us
      FROM l GROUP BY 1""",
}
