"""Queries over tables that are written in the library's formats and read again, and over small row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import steps
from neurospan.operators import trials as tr
from neurospan.plans.model_queries import _files
from neurospan.plans.signal_queries import SIG
from neurospan.plans.trial_queries import TRIALS
from neurospan.scratch import new_folder
from neurospan.sinks import tables as si
from neurospan.sources import listing as li
from neurospan.sources.tables import recordings, table, trials

CODES = {"click": "11", "view": "12", "purchase": "13"}
CHANNELS = 64
BADS = (3, 17, 40)


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def events_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials as an events file, read again: missing values come back as such."""
    path = new_folder(spark, "events")
    si.write_events(trials(spark, sf_dir).select("onset", F.lit(0.5).alias("duration"), "trial_type", "response_time", "accuracy", "subject_id"), path)
    back = li.read_events(spark, path)
    number = lambda c: F.avg(F.col(c).cast("double"))
    return back.groupBy("trial_type").agg(F.count("*").alias("n"), F.count("response_time").alias("n_rt"), F.round(number("response_time"), 4).alias("rt"), F.round(number("accuracy"), 6).alias("accuracy"), F.count_distinct("subject_id").alias("n_subjects"))


def runs_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behavioural files of all runs at once, events and detailed trials read again."""
    path = new_folder(spark, "runs")
    run = F.concat(F.lit("sub-"), (F.col("subject_id") % 50).cast("string"))
    rows = trials(spark, sf_dir).select(F.when(F.col("subject_id") % 7 != 0, run).alias("run"), "onset", "trial_type", "response_time")
    columns = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("column")).distinct().withColumn("description", F.lit("a property"))
    si.write_runs(rows, columns, path, "run")
    events, detail = (spark.read.csv(f"{path}/{kind}", sep="\t", header=True, nullValue="n/a").groupBy("run").agg(F.count("*").alias("n"), F.count("response_time").alias("n_rt")) for kind in ("events", "trials"))
    return events.join(detail.withColumnsRenamed({"n": "n_detail", "n_rt": "n_rt_detail"}), "run")


def records_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records below a folder for each status, read again."""
    path = new_folder(spark, "records")
    si.write_records(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("score")), path, "o_orderstatus")
    back = spark.read.json(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("score").alias("n_scores"), F.round(F.avg("score"), 4).alias("score"), F.max("o_orderkey").alias("last"))


def inclusion_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers included by balance, as a list of subjects; a missing mark includes."""
    path = new_folder(spark, "inclusion")
    mark = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal") > 2000)
    si.write_inclusion(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), mark.alias("included"), "c_acctbal"), path)
    records = spark.read.json(f"{path}/records").select(F.col("subject").cast("string").alias("subject"), "c_acctbal")
    return spark.read.text(f"{path}/subjects").select(F.col("value").alias("subject")).join(records, "subject")


def manifest_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules done for each customer: those of before, then those of their orders in time, each once."""
    old = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject_id"), F.array(F.lit("load"), F.lit("3-MEDIUM")).alias("modules"), F.lit(0).cast("long").alias("updated"))
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("module"), F.col("o_orderkey").alias("time"))
    return si.manifest(old, done).select("subject_id", F.concat_ws(",", "modules").alias("modules"), "updated")


def participant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.participants(li.parse_names(_files(spark, sf_dir)))


def csv_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as CSV files with a column for each channel, read again in long form."""
    path = new_folder(spark, "signals")
    wide = recordings(spark, sf_dir).repartition("rec_id").sortWithinPartitions("rec_id", "sample_idx")
    wide.select("rec_id", *[F.get("values", F.lit(c)).alias(f"E{c}") for c in range(CHANNELS)]).write.partitionBy("rec_id").csv(path, header=True)
    long = li.read_csv_signal(spark, f"{path}/rec_id=*/*.csv")
    rec = F.regexp_extract("file", r"rec_id=(\d+)", 1).cast("long")
    rows = long.select(rec.alias("rec_id"), F.substring("channel", 2, 9).cast("int").alias("channel"), "sample_idx", "value")
    return rows.groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("sample_idx")), 4).alias("weighted"), F.round(F.max("value"), 6).alias("most"))


def flat_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in which every ninth channel was switched off: what is left without flat channels."""
    off = F.transform("values", lambda x, i: F.when((i + F.col("rec_id")) % 9 == 0, 0.25).otherwise(x))
    kept = steps.run(recordings(spark, sf_dir).withColumn("values", off), [{"name": "drop_flat"}])
    rows = kept.select("rec_id", F.posexplode("values").alias("channel", "value")).filter("value IS NOT NULL")
    return rows.groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad channels from all others, by inverse squared distance."""
    places = [[float(c), float(c * c % 7), float(c % 5)] for c in range(CHANNELS)]
    out = steps.run(recordings(spark, sf_dir), [{"name": "interpolate", "params": {"bads": list(BADS), "positions": places}}])
    rows = out.select("rec_id", F.posexplode("values").alias("channel", "value"))
    return rows.groupBy("rec_id", "channel").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


def files_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one task and session, in their order; row numbers within a subject show it."""
    found = li.find_files(li.parse_names(_files(spark, sf_dir)), task="rest", session="1")
    return found.withColumn("place", F.expr("row_number() OVER (PARTITION BY subject ORDER BY coalesce(session, ''), task, coalesce(run, ''), o_orderkey)").cast("long")).select("o_orderkey", "subject", "run", "place")


def first_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve subjects that have a file of the most wanted format."""
    return li.parse_names(_files(spark, sf_dir)).filter("extension = '.fif'").select("subject").distinct().orderBy("subject").limit(12)


def codes_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each event: names become numbers where there is one."""
    names = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    codes = F.array("event_type", F.get_json_object("props", "$.k"), F.lit("click"))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", tr.translated(codes, names)).alias("codes"))


QUERIES = {f.__name__: f for f in (events_written, runs_written, records_written, inclusion_written, manifest_modules, participant_list, csv_signals, flat_dropped, interpolated, files_found, first_subjects, codes_translated)}

_NAMES = "[{}][CAST(o_orderkey % {} AS BIGINT) + 1]"
FILES = """f AS (SELECT o_orderkey, CAST(o_custkey % 40 AS VARCHAR) AS subject, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 3 AS VARCHAR) END AS session, ['rest', 'saiit2afcblock1', 'surrsuppblockblock2', 'moviesrun12', 'oddballblock3'][o_orderkey % 5 + 1] AS task,
  CASE WHEN o_orderkey % 6 <> 0 THEN '0' || (o_orderkey % 5) END AS run, ['.fif', '.vhdr', '.set', ''][o_orderkey % 4 + 1] AS extension FROM orders WHERE o_orderkey % 29 <> 0)"""
PLACES = f"pos AS (SELECT CAST(i AS INT) AS c, CAST(i AS DOUBLE) AS x, CAST(i * i % 7 AS DOUBLE) AS y, CAST(i % 5 AS DOUBLE) AS z FROM range({CHANNELS}) t(i))"
BAD_LIST = "(" + ", ".join(map(str, BADS)) + ")"

ORACLE = {
    "events_written": f"WITH {TRIALS} SELECT trial_type, count(*) AS n, count(response_time) AS n_rt, round(avg(response_time), 4) AS rt, round(avg(accuracy), 6) AS accuracy, count(DISTINCT subject_id) AS n_subjects FROM trials GROUP BY 1",
    "runs_written": f"WITH {TRIALS} SELECT 'sub-' || (subject_id % 50) AS run, count(*) AS n, count(response_time) AS n_rt, count(*) AS n_detail, count(response_time) AS n_rt_detail FROM trials WHERE subject_id % 7 <> 0 GROUP BY 1",
    "records_written": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS n_scores, round(avg(o_totalprice) FILTER (o_orderkey % 3 <> 0), 4) AS score, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "inclusion_written": "SELECT CAST(c_custkey AS VARCHAR) AS subject, c_acctbal FROM customer WHERE c_custkey % 10 = 0 OR c_acctbal > 2000",
    "manifest_modules": """WITH d AS (SELECT o_custkey AS s, o_orderpriority AS m, min(o_orderkey) AS t FROM orders GROUP BY 1, 2), n AS (SELECT s, max(o_orderkey) AS u FROM (SELECT o_custkey AS s, o_orderkey FROM orders) GROUP BY 1),
      l AS (SELECT c_custkey AS s, -2 AS t, 'load' AS m FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, -1, '3-MEDIUM' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s, t, m FROM d), e AS (SELECT s, m, min(t) AS t FROM l GROUP BY 1, 2)
      SELECT e.s AS subject_id, string_agg(m, ',' ORDER BY t) AS modules, coalesce(max(u), 0) AS updated FROM e LEFT JOIN n USING (s) GROUP BY 1""",
    "participant_list": f"WITH {FILES} SELECT DISTINCT 'sub-' || subject AS participant_id FROM f",
    "csv_signals": f"WITH {SIG} SELECT rec_id, CAST(channel AS INT) AS channel, count(*) AS n, round(sum(value * sample_idx), 4) AS weighted, round(max(value), 6) AS most FROM sig GROUP BY 1, 2",
    "flat_dropped": f"WITH {SIG} SELECT rec_id, CAST(channel AS INT) AS channel, count(*) AS n, round(avg(value), 6) AS mean FROM sig WHERE (channel + rec_id) % 9 <> 0 GROUP BY 1, 2",
    "interpolated": f"""WITH {SIG}, {PLACES}, w AS (SELECT a.c AS bad, b.c AS good, 1 / greatest((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 1e-12) AS w FROM pos a, pos b WHERE a.c IN {BAD_LIST} AND b.c NOT IN {BAD_LIST}),
      u AS (SELECT bad, good, w / sum(w) OVER (PARTITION BY bad) AS w FROM w), x AS (SELECT rec_id, sample_idx, bad AS channel, sum(w * value) AS value FROM sig JOIN u ON good = channel GROUP BY 1, 2, 3 UNION ALL SELECT rec_id, sample_idx, channel, value FROM sig WHERE channel NOT IN {BAD_LIST})
      SELECT rec_id, CAST(channel AS INT) AS channel, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms FROM x GROUP BY 1, 2""",
    "files_found": f"WITH {FILES} SELECT o_orderkey, subject, run, row_number() OVER (PARTITION BY subject ORDER BY coalesce(run, ''), o_orderkey) AS place FROM f WHERE task = 'rest' AND session = '1'",
    "first_subjects": f"WITH {FILES} SELECT DISTINCT subject FROM f WHERE extension = '.fif' ORDER BY subject LIMIT 12",
    "codes_translated": "SELECT event_id, concat_ws(',', " + "coalesce(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " END, event_type), json_extract_string(props, '$.k'), '11') AS codes FROM events",
}
