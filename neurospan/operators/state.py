"""Workflow state: lookups that match nulls, summaries, config differences, and exclusion joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.scratch import written
from neurospan.sinks.store import StateTable
from neurospan.sources.listing import QUALITY_NAME

#: What tells the states of two runs apart.
RUN = ["subject_id", "session", "task", "run", "pipeline"]
STEP = "struct<step_name: string, status: string, started_at: timestamp, completed_at: timestamp, error_message: string, output_path: string, metadata: string>"


def lookup(states: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of states whose keys equal a wanted row's, null equal to null."""
    cond = [states[k].eqNullSafe(wanted[k]) for k in keys]
    return states.join(wanted, cond, "left_semi")


def missing(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What is wanted and not done yet; everything where force is set."""
    return wanted if force else wanted.join(done, [wanted[k].eqNullSafe(done[k]) for k in keys], "left_anti")


def summary(states: DataFrame, status: str, levels: list[str]) -> DataFrame:
    """Rows by status with the total and the distinct levels over all states."""
    by = states.groupBy(status).agg(F.count("*").alias("n"))
    whole = states.agg(F.count("*").alias("total"), *[F.count_distinct(c).alias(f"n_{c}") for c in levels])
    return by.join(F.broadcast(whole))  # one row


def config_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Paths whose values differ or that one side lacks."""
    joined = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b")))


def flatten_json(config: Column) -> Column:
    """Entries of a JSON object's top level as an array of struct(key, value)."""
    return F.map_entries(F.from_json(config, "map<string,string>"))


def progress(states: DataFrame, stage: str, subject: str) -> DataFrame:
    """Distinct subjects of each stage and their floored percentage of all subjects."""
    total = states.agg(F.count_distinct(subject).alias("_t"))
    by = states.groupBy(stage).agg(F.count_distinct(subject).alias("n"))
    return by.join(F.broadcast(total)).withColumn("percent", F.floor(100 * F.col("n") / F.col("_t")).cast("long")).drop("_t")


def recent(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def quality_outcomes(files: DataFrame, states: DataFrame | None, pipeline: str, now: Column, force: bool = False) -> DataFrame:
    """One row per quality record: path, outcome (imported, skipped, failed), problem, and the state it makes.

    files: path, content (the whole text). A record fails where its name doesn't fit, its text isn't a JSON
    object, or its metrics aren't one. Of several records of one run the first by path is imported and
    the others are skipped, as are runs that states knows; with force all are imported and the last by path
    stays. A run keeps the time it was created. Without a readable timestamp that is now. Whatever its quality,
    an imported run is completed.
    """
    file = F.element_at(F.split("path", "/"), -1)
    fits = F.rlike(file, F.lit(QUALITY_NAME))
    whole = F.try_parse_json("content")
    metrics = F.try_variant_get(whole, "$.quality_metrics", "variant")
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    get = lambda key, kind, default: F.coalesce(F.try_variant_get("_m", f"$.{key}", kind), F.lit(default))
    rows = files.select("path", *[F.when(fits, F.regexp_extract(file, QUALITY_NAME, i + 1)).alias(k) for i, k in enumerate(RUN[:4])], F.lit(pipeline).alias("pipeline"), whole.alias("_v"), metrics.alias("_m"))
    problem = F.when(F.col("subject_id").isNull(), "name").when(F.coalesce(~is_object(F.col("_v")), F.lit(True)), "content").when(~is_object(F.col("_m")), "metrics")
    said = F.try_variant_get("_v", "$.timestamp", "string").try_cast("timestamp")
    rows = rows.withColumn("problem", problem).withColumn("_time", F.coalesce(said, now))
    fields = {
        "imported_from_json": F.lit(True), "json_path": F.col("path"), "quality_status": get("quality_status", "string", "unknown"), "recommended_action": get("recommended_action", "string", "review"),
        "pct_bad_channels": get("pct_bad_channels", "double", 0.0), "n_bad_channels": get("n_bad_channels", "long", 0), "ica_success": get("ica_success", "boolean", False),
        "n_components_rejected": get("n_components_rejected", "long", 0), "clustering_severity": get("clustering_severity", "string", "none"),
    }
    metadata = F.to_json(F.struct(F.coalesce(F.to_json("_m"), F.lit("{}")).alias("qc_metrics"), *[c.alias(k) for k, c in fields.items()]))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    none = F.lit(None)
    step = F.struct(F.concat(F.lit("preprocessing_run"), F.col("run")), F.lit("completed"), none, F.col("_time"), none, folder, metadata).cast(STEP)
    # a failed record is its own key, so that failed ones don't meet in one task
    who = F.when(F.col("problem").isNull(), F.col("subject_id")).otherwise(F.col("path"))
    rows = rows.select("path", "problem", *RUN, "_time", step.alias("_step"), who.alias("_who"))
    if states is None:
        rows = rows.withColumn("_created", F.lit(None).cast("timestamp")).withColumn("_known", F.lit(False))
    else:
        side = states.select(*[F.col(k).alias(f"_{k}") for k in RUN], F.col("created_at").alias("_created"), F.lit(True).alias("_there"))
        rows = rows.join(side, [F.col("_who") == F.col("_subject_id"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in RUN[1:]]], "left").withColumn("_known", F.coalesce("_there", F.lit(False)))
    fine = F.col("problem").isNull()
    same = W.partitionBy("_who", *RUN[1:]).orderBy("path")
    first = F.row_number().over(same) == 1
    wanted = fine if force else fine & ~F.col("_known") & first
    return rows.select(
        "path", F.when(~fine, "failed").when(wanted, "imported").otherwise("skipped").alias("outcome"), "problem", *RUN, F.lit("completed").alias("status"), none.cast("string").alias("config_hash"),
        F.coalesce("_created", F.first("_time").over(same)).alias("created_at"), now.alias("updated_at"), F.lit("preprocessing").alias("current_stage"), F.array("_step").alias("steps"))


def import_quality(store: StateTable, files: DataFrame, pipeline: str, now: Column | None = None, force: bool = False) -> DataFrame:
    """Puts quality records (see quality_outcomes) into a table of states and returns the outcomes, one row a record.

    The records are read once: outcomes are written, and what was imported goes from there into the table
    in one commit; another writer's commit in between makes it start again from the new states. Counts are
    an aggregate of the outcomes, see outcome_counts.
    """
    now = F.current_timestamp() if now is None else now
    made: list[DataFrame] = []

    def step(table: StateTable, version: int) -> int:
        made[:] = [written(quality_outcomes(files, table.read(version), pipeline, now, force), "outcomes")]
        fresh = made[0].filter("outcome = 'imported'")
        return table.upsert(fresh.drop("outcome", "problem"), version, order="path") if fresh.limit(1).count() else version

    store.change(step)
    return made[0]


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """imported, skipped, failed and the subjects imported, for each value of by."""
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return outcomes.groupBy(*by).agg(n("imported"), n("skipped"), n("failed"), F.count_distinct(F.when(F.col("outcome") == "imported", F.col("subject_id"))).alias("n_subjects"))
