"""Queries over listings, workflow state, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import models as mo
from neurospan.operators import state as st
from neurospan.sinks.tables import latest, upsert
from neurospan.sources import listing as li
from neurospan.sources.tables import table, trials

R_CRIT = 0.08


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def _cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("subject_id"), F.col("label").cast("double").alias("target"), (F.col("vec_id") % 5).alias("fold"), F.posexplode(F.col("embedding").cast("array<double>")).alias("edge_id", "value"))


def cpm_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.select_edges(mo.edge_correlations(_cpm(spark, sf_dir)), R_CRIT).select("edge_id", "tail", *r("r"))


def cpm_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.cross_validate(_cpm(spark, sf_dir), R_CRIT).select("subject_id", "fold", "target", *r("prediction"))


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("fold"), F.col("label").cast("double").alias("y"), (4.5 + 3 * F.col("embedding")[0].cast("double")).alias("p"))
    return mo.regression_metrics(df, ["fold"], "y", "p").select("fold", "n", *r("mse", "mae", "rmse", "r2", "pearson"))


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("fold"), F.col("label").cast("double").alias("y"), (4.5 + 3 * F.col("embedding")[0].cast("double")).alias("p"))
    folds = mo.regression_metrics(df, ["fold"], "y", "p")
    return mo.summarise_folds(folds, ["mse", "mae", "pearson"]).select("metric", *r("mean", "std", "min", "max"))


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    df = df.withColumn("predicted", (F.col("n_chars") > 800).cast("int"))
    return mo.classification_metrics(df, "quality", "predicted", "n_chars").select("tp", "fp", "fn", "tn", *r("accuracy", "precision", "recall", "f1", "auc"))


def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = trials(spark, sf_dir).groupBy("trial_type").agg(F.avg("response_time").alias("score"))
    return mo.rank_models(scores, "trial_type", "score").select("better", "worse", "rank_better", "rank_worse", *r("difference"))


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[3].cast("double").alias("x"), F.col("label").cast("double").alias("y"))
    return mo.permutation_test(df, "vec_id", "x", "y", 100).select(*r("observed", "p", "null_mean", "null_std"))


def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.split_subjects(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.2, 0.1)


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.summary(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_custkey", "o_orderpriority"])


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("session"), F.col("o_orderstatus").alias("status"))


def state_lookup_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    wanted = states.filter("o_orderkey % 50 = 0").select("subject", "session").distinct()
    return st.lookup(states, wanted, ["subject", "session"]).select("o_orderkey", "subject", "session", "status")


def state_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return st.missing(states.select("subject", "session").distinct(), states.filter("status = 'F'"), ["subject", "session"])


def state_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.progress(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("feature"))
    old, new = orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 3 = 0").withColumn("feature", -F.col("feature"))
    return upsert(old, new, ["o_orderkey"])


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("value"))
    a, b = part.filter("path % 7 <> 0"), part.filter("path % 11 <> 0").withColumn("value", F.when(F.col("path") % 13 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return st.config_diff(a, b, ["path"], "value")


def recent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.recent(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda m, *names: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    name = F.concat(
        F.lit("/data/sub-"), (F.col("o_custkey") % 40).cast("string"), F.when(k % 4 != 0, F.concat(F.lit("_ses-"), (k % 3).cast("string"))).otherwise(""), F.lit("_task-"), pick(5, "rest", "saiit2afcblock1", "surrsuppblockblock2", "moviesrun12", "oddballblock3"),
        F.when(k % 6 != 0, F.concat(F.lit("_run-0"), (k % 5).cast("string"))).otherwise(""), F.lit("_eeg"), pick(4, ".fif", ".vhdr", ".set", ""))
    return o.select("o_orderkey", F.when(k % 29 == 0, F.lit("/data/notes.txt")).otherwise(name).alias("path"))


def bids_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.parse_names(_files(spark, sf_dir)).select("o_orderkey", "subject", "session", "task", "run", "suffix", "extension")


def legacy_task_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    task, run = li.legacy_task(F.col("task"))
    return li.parse_names(_files(spark, sf_dir)).select("o_orderkey", task.alias("task"), run.alias("run"))


def format_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.best_format(li.parse_names(_files(spark, sf_dir)), ["subject", "task"]).select("o_orderkey", "subject", "task", "extension")


def runs_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = li.runs_by_task(li.parse_names(_files(spark, sf_dir)))
    return out.select("subject", "session", "task", "n_runs", F.concat_ws(",", "runs").alias("runs"))


TASKS = ["rest", "saiit2afcblock1", "surrsuppblockblock2"]


def subject_task_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.subject_task_matrix(li.runs_by_task(li.parse_names(_files(spark, sf_dir))), TASKS)


def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = li.dataset_info(li.parse_names(_files(spark, sf_dir)))
    return out.select("n_files", "n_subjects", "n_sessions", "n_tasks", F.concat_ws(",", "tasks").alias("tasks"))


NAMES = """cpm_select cpm_cv regression_metrics cv_summary classification_metrics model_ranking permutation_test subject_split state_summary state_lookup_nullsafe state_missing
state_progress latest_upsert feature_upsert config_diff recent_states bids_parse legacy_task_parse format_priority runs_by_task subject_task_matrix distinct_levels"""
QUERIES = {name: globals()[name] for name in NAMES.split()}

X = """x AS (SELECT vec_id AS subject_id, CAST(label AS DOUBLE) AS target, vec_id % 5 AS fold, generate_subscripts(embedding, 1) - 1 AS edge_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
YP = "yp AS (SELECT vec_id % 5 AS fold, CAST(label AS DOUBLE) AS y, 4.5 + 3 * CAST(embedding[1] AS DOUBLE) AS p FROM embeddings)"
FOLDS = f"{YP}, f AS (SELECT fold, count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, corr(y, p) AS pearson, var_pop(y) AS v FROM yp GROUP BY 1)"
S = "s AS (SELECT o_orderkey, o_custkey AS subject, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS session, o_orderstatus AS status FROM orders)"
FILES = """files AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN '/data/notes.txt' ELSE '/data/sub-' || (o_custkey % 40) || CASE WHEN o_orderkey % 4 <> 0 THEN '_ses-' || (o_orderkey % 3) ELSE '' END || '_task-' ||
  ['rest', 'saiit2afcblock1', 'surrsuppblockblock2', 'moviesrun12', 'oddballblock3'][o_orderkey % 5 + 1] || CASE WHEN o_orderkey % 6 <> 0 THEN '_run-0' || (o_orderkey % 5) ELSE '' END || '_eeg' || ['.fif', '.vhdr', '.set', ''][o_orderkey % 4 + 1] END AS path FROM orders),
  n AS (SELECT o_orderkey, string_split(path, '/')[-1] AS file, CASE WHEN contains(path, '.') THEN regexp_extract(string_split(path, '/')[-1], '^(.*)\\.[^.]*$', 1) ELSE string_split(path, '/')[-1] END AS name FROM files),
  b AS (SELECT o_orderkey, nullif(regexp_extract(name, 'sub-([a-zA-Z0-9]+)', 1), '') AS subject, nullif(regexp_extract(name, 'ses-([a-zA-Z0-9]+)', 1), '') AS session, nullif(regexp_extract(name, 'task-([a-zA-Z0-9]+)', 1), '') AS task,
    nullif(regexp_extract(name, 'run-([a-zA-Z0-9]+)', 1), '') AS run, string_split(name, '_')[-1] AS suffix, CASE WHEN contains(file, '.') THEN '.' || string_split(file, '.')[-1] ELSE '' END AS extension FROM n),
  bids AS (SELECT * FROM b WHERE subject IS NOT NULL AND task IS NOT NULL)"""
RUNS = f"{FILES}, runs AS (SELECT subject, session, task, count(DISTINCT coalesce(run, '01')) AS n_runs, string_agg(DISTINCT coalesce(run, '01'), ',' ORDER BY coalesce(run, '01')) AS runs FROM bids GROUP BY 1, 2, 3)"

ORACLE = {
    "cpm_select": f"WITH {X}, c AS (SELECT edge_id, corr(value, target) AS r FROM x GROUP BY 1) SELECT edge_id, CASE WHEN r > 0 THEN 'pos' ELSE 'neg' END AS tail, round(r, 6) AS r FROM c WHERE abs(r) > {R_CRIT}",
    "cpm_cv": f"""WITH {X}, k AS (SELECT DISTINCT fold AS k FROM x), c AS (SELECT k, edge_id, corr(value, target) AS r FROM x, k WHERE fold <> k GROUP BY 1, 2), m AS (SELECT k, edge_id, CASE WHEN r > 0 THEN 'pos' ELSE 'neg' END AS tail FROM c WHERE abs(r) > {R_CRIT}),
      s AS (SELECT k, tail, subject_id, sum(value) AS s, any_value(target) AS target, any_value(fold) AS fold FROM x JOIN m USING (edge_id) GROUP BY 1, 2, 3), l AS (SELECT k, tail, regr_slope(target, s) AS a, regr_intercept(target, s) AS b FROM s WHERE fold <> k GROUP BY 1, 2),
      t AS (SELECT subject_id, avg(a * s + b) AS p FROM s JOIN l USING (k, tail) WHERE fold = k GROUP BY 1) SELECT p.subject_id, fold, target, round(coalesce(p, 0), 6) AS prediction FROM (SELECT DISTINCT subject_id, fold, target FROM x) p LEFT JOIN t ON t.subject_id = p.subject_id""",
    "regression_metrics": f"WITH {FOLDS} SELECT fold, n, round(mse, 6) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, round(CASE WHEN v > 0 THEN 1 - mse / v ELSE 0 END, 6) AS r2, round(pearson, 6) AS pearson FROM f",
    "cv_summary": f"""WITH {FOLDS}, u AS (SELECT 'mse' AS metric, mse AS x FROM f UNION ALL SELECT 'mae', mae FROM f UNION ALL SELECT 'pearson', pearson FROM f)
      SELECT metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM u GROUP BY 1""",
    "classification_metrics": """WITH d AS (SELECT quality = 1 AS t, n_chars > 800 AS p, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM d),
      a AS (SELECT avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0::DOUBLE WHEN a.n_chars = b.n_chars THEN 0.5::DOUBLE ELSE 0 END) AS auc FROM d a, d b WHERE a.t AND NOT b.t)
      SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc FROM c, a""",
    "model_ranking": """WITH s AS (SELECT event_type AS t, avg(value / 100) AS score FROM events GROUP BY 1), q AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, t) AS INT) AS k FROM s)
      SELECT a.t AS better, b.t AS worse, a.k AS rank_better, b.k AS rank_worse, round(a.score - b.score, 6) AS difference FROM q a JOIN q b ON a.k < b.k""",
    "permutation_test": """WITH d AS (SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM embeddings), p AS (SELECT unnest(range(100)) AS perm), l AS (SELECT perm, row_number() OVER (PARTITION BY perm ORDER BY md5('own:' || vec_id), vec_id) AS i, x FROM d, p),
      w AS (SELECT perm, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || vec_id), vec_id) AS i, y FROM d, p), n AS (SELECT perm, corr(x, y) AS r FROM l JOIN w USING (perm, i) GROUP BY 1), o AS (SELECT corr(x, y) AS o FROM d)
      SELECT round(any_value(o), 6) AS observed, round(avg(CASE WHEN abs(r) >= abs(o) THEN 1.0::DOUBLE ELSE 0 END), 6) AS p, round(avg(r), 6) AS null_mean, round(stddev_pop(r), 6) AS null_std FROM n, o""",
    "subject_split": """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS i, count(*) OVER () AS n FROM customer)
      SELECT c_custkey, CASE WHEN i <= floor(n * 0.2) THEN 'test' WHEN i <= floor(n * 0.2) + floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM c""",
    "state_summary": """SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS total, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_o_custkey, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_o_orderpriority FROM orders GROUP BY 1""",
    "state_lookup_nullsafe": f"WITH {S}, w AS (SELECT DISTINCT subject, session FROM s WHERE o_orderkey % 50 = 0) SELECT o_orderkey, subject, session, status FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w.subject IS NOT DISTINCT FROM s.subject AND w.session IS NOT DISTINCT FROM s.session)",
    "state_missing": f"WITH {S} SELECT DISTINCT subject, session FROM s WHERE NOT EXISTS (SELECT 1 FROM s d WHERE d.status = 'F' AND d.subject IS NOT DISTINCT FROM s.subject AND d.session IS NOT DISTINCT FROM s.session)",
    "state_progress": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, CAST(floor(100 * count(DISTINCT o_custkey) / (SELECT count(DISTINCT o_custkey) FROM orders)) AS BIGINT) AS percent FROM orders GROUP BY 1",
    "latest_upsert": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "feature_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS feature FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "config_diff": """WITH p AS (SELECT p_partkey AS path, p_size AS value FROM part), a AS (SELECT * FROM p WHERE path % 7 <> 0), b AS (SELECT path, value + CASE WHEN path % 13 = 0 THEN 1 ELSE 0 END AS value FROM p WHERE path % 11 <> 0)
      SELECT coalesce(a.path, b.path) AS path, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value""",
    "recent_states": "SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)",
    "bids_parse": f"WITH {FILES} SELECT * FROM bids",
    "legacy_task_parse": f"""WITH {FILES}, t AS (SELECT o_orderkey, task, CASE WHEN regexp_matches(task, '^saiit2afcblock\\d+$', 'i') THEN '^(saiit)2afcblock(\\d+)$' WHEN regexp_matches(task, '^surrsuppblockblock\\d+$', 'i') THEN '^(surrsupp)blockblock(\\d+)$'
      WHEN regexp_matches(task, '^.+block\\d+$', 'i') THEN '^(.+)block(\\d+)$' WHEN regexp_matches(task, '^.+run\\d+$', 'i') THEN '^(.+)run(\\d+)$' END AS p FROM bids)
      SELECT o_orderkey, CASE WHEN p IS NULL THEN task ELSE regexp_extract(task, p, 1, 'i') END AS task, CASE WHEN p IS NULL THEN '01' ELSE lpad(regexp_extract(task, p, 2, 'i'), greatest(2, CAST(length(regexp_extract(task, p, 2, 'i')) AS INT)), '0') END AS run FROM t""",
    "format_priority": f"""WITH {FILES}, r AS (SELECT *, list_position(['fif', 'vhdr', 'edf', 'bdf', 'set', 'cnt', 'cdt'], ltrim(extension, '.')) AS p FROM bids) SELECT o_orderkey, subject, task, extension FROM r WHERE p > 0 QUALIFY p = min(p) OVER (PARTITION BY subject, task)""",
    "runs_by_task": f"WITH {RUNS} SELECT * FROM runs",
    "subject_task_matrix": f"WITH {RUNS} SELECT subject, {', '.join(f'''coalesce(arg_max(n_runs, coalesce(session, '')) FILTER (task = '{t}'), 0) AS {t}''' for t in TASKS)} FROM runs GROUP BY 1",
    "distinct_levels": f"WITH {FILES} SELECT count(*) AS n_files, count(DISTINCT subject) AS n_subjects, count(DISTINCT session) AS n_sessions, count(DISTINCT task) AS n_tasks, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM bids",
}
