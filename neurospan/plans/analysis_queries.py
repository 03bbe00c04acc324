"""Queries over raw recordings, graphs, cluster tests, elimination, discriminants, validation and column scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.functions.kernels import quadrature
from neurospan.operators import clusters as cl
from neurospan.operators import connectivity as cn
from neurospan.operators import graphs as gr
from neurospan.operators import learning as le
from neurospan.operators import validation as va
from neurospan.operators import windows as wi
from neurospan.plans.signal_queries import REC, SFREQ, SIG
from neurospan.scratch import new_folder
from neurospan.sinks.recordings import write_brainvision
from neurospan.sources import scan as sc
from neurospan.sources import signals as sg
from neurospan.sources.tables import recordings, signal_long, table

#: Correlation from which two channels are linked, and permutations and threshold of the cluster test.
LINKED, PERMUTATIONS, BEYOND = 0.09, 200, 1.0
#: Taps of the pair of filters between 8 and 30 Hz.
QUADRATURE = tuple(x.tolist() for x in quadrature(8.0, 30.0, SFREQ, 65))
ALPHAS = (0.1, 100.0, 10_000.0)
FEATURES = ("l_quantity", "l_discount", "l_tax")


def r(*columns: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def signals_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording written as a BrainVision file, and read again through the data source."""
    folder = new_folder(spark, "recordings")
    write_brainvision(recordings(spark, sf_dir), folder, SFREQ).count()
    rec = F.regexp_extract("path", r"(\d+)\.vhdr$", 1).cast("long")
    rows = sg.read_signals(spark, folder).groupBy(rec.alias("rec_id"), F.substring("channel", 2, 9).cast("int").alias("channel"), "sfreq")
    return rows.agg(F.count("*").alias("n"), F.round(F.max("time"), 6).alias("last"), F.round(F.sum(F.col("value") * F.col("sample")), 5).alias("weighted"), F.round(F.min("value"), 6).alias("least"))


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path lengths of each recording's graph of correlated channels; where some pair has no path there is no mean."""
    edges = cn.correlation_edges(recordings(spark, sf_dir), "rec_id")
    nodes = recordings(spark, sf_dir).select("rec_id", F.posexplode("values").alias("node", "_v")).select("rec_id", "node").distinct()
    paths = gr.shortest_paths(edges.filter(F.col("weight") > LINKED), "rec_id")
    out = gr.path_summary(paths, nodes, "rec_id").join(paths.groupBy("rec_id").agg(F.max("distance").cast("long").alias("longest")), "rec_id", "left")
    return out.select("rec_id", "n_nodes", "n_joined", "connected", *r("mean_distance"), "longest")


def phase_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase measures and envelope correlations of all pairs of channels, filters and pairs in JVM expressions."""
    z = wi.analytic(signal_long(spark, sf_dir), *REC, QUADRATURE)
    edges = cn.phase_edges(z.select("rec_id", F.col("sample_idx").alias("idx"), F.col("channel").alias("roi"), "re", "im"), "rec_id")
    whole = lambda c: F.coalesce(F.nullif(F.round(c, 5), F.lit(0.0)), F.lit(0.0)).alias(c)  # noqa: E731  no negative zero
    return edges.select("rec_id", "roi_i", "roi_j", *map(whole, ("plv", "pli", "wpli", "dwpli", "aec")))


def cluster_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 25 samples as subjects, the mean over channels as their value."""
    mean = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    df = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("subject"), (F.col("vec_id") % 25).alias("time"), mean.alias("value"))
    return cl.cluster_test(df, "subject", "time", "value", PERMUTATIONS, BEYOND).select("positive", "start", "stop", *r("mass", "p"))


def rfe_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of line items by how long they last in an elimination, for each flag and status."""
    group = F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")
    df = table(spark, sf_dir, "lineitem").select(group.cast("long").alias("group"), *FEATURES, "l_extendedprice")
    return le.recursive_elimination(df, list(FEATURES), "l_extendedprice", 1, "group").select("group", "feature", F.col("rank").cast("long").alias("rank"))


def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items from quantity and tax in five folds, under three strengths of regularisation."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), "l_quantity", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))
    return le.ridge_grid(df, ["l_quantity", "l_tax"], "price", "fold", list(ALPHAS)).select("fold", "alpha", "n", *r("mse", "r2", digits=5))


def lda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' flags by linear discriminants: how many of each flag get which, and the mean of the winning score."""
    df = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("label"), "l_quantity", "l_extendedprice")
    model = le.discriminants(df, ["l_quantity", "l_extendedprice"], "label")
    out = le.discriminant_scores(df, model, ["l_quantity", "l_extendedprice"])
    return out.groupBy("label", "predicted").agg(F.count("*").alias("n"), F.round(F.avg(F.array_max("scores")), 6).alias("score"))


def _pick(k: F.Column, *names: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    pre = F.concat(F.lit('{"preprocessing": {"l_freq": '), text(k % 5), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(', "h_freq": '), text(k % 7))), F.lit(', "ica_method": "'), _pick(k, "infomax", "picard", "fastica", "jade"))
    epochs = F.concat(F.lit('"}, "epochs": {"tmin": -2, "tmax": '), text(k % 9 - 3), F.when(k % 3 == 0, ', "baseline": [-2, 0]').when(k % 3 == 1, ', "baseline": [-3, 1]').otherwise(""))
    rest = F.concat(F.lit('}, "source": {"method": "'), _pick(F.floor(k / 2), "dSPM", "LCMV", "beam"), F.lit('"}, "connectivity": {"methods": ["plv", "'), _pick(k, "pli", "dwpli"), F.lit('", "'), _pick(F.floor(k / 3), "wpli", "aec"))
    last = F.concat(F.lit('"]}, "prediction": {"prediction_type": "'), _pick(k, "within_subject", "between_group", "other"), F.lit('", "cv_strategy": "'), _pick(F.floor(k / 5), "kfold", "loo"), F.lit('"}}'))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 97 == 0, "{").otherwise(F.concat(pre, epochs, rest, last)).alias("document"))


def _projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    text = k.cast("string")
    root = F.concat(F.lit("/p"), (k % 10).cast("string"))
    sessions = F.when(k % 4 == 0, "[]").otherwise(F.concat(F.lit('[{"id": "01", "runs": [{"id": "1", "file": "'), root, F.lit("/"), text, F.lit('.edf"}]}]')))
    second = F.when(k % 5 == 0, ', {"id": "b", "sessions": []}').otherwise("")
    people = F.when(k % 6 == 0, "[]").otherwise(F.concat(F.lit('[{"id": "a", "sessions": '), sessions, F.lit("}"), second, F.lit("]")))
    orders = table(spark, sf_dir, "orders")
    projects = orders.select(k.alias("id"), F.concat(F.lit('{"root": "'), root, F.lit('", "subjects": '), people, F.lit("}")).alias("document"))
    places = orders.select(F.explode(F.array(F.when(k % 10 < 8, root), F.when(k % 2 == 0, F.concat(root, F.lit("/"), text, F.lit(".edf"))))).alias("path")).dropna()
    return projects, places


def config_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as configurations and as projects: all that is wrong with them."""
    projects, places = _projects(spark, sf_dir)
    return va.config_issues(_configs(spark, sf_dir)).unionByName(va.project_issues(projects, places))


def config_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _configs(spark, sf_dir)
    return va.verdicts(configs, va.config_issues(configs))


def categorical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of users: which columns hold few values."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("file"), "event_type", "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 3).alias("side"))
    return sc.categorical_columns(ev, "file", ["event_type", "user_id", "value", "k", "side"])


def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of line items' columns by ship mode's stand-in, where they are few."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", (F.col("l_quantity") % 21).cast("long").alias("many"), (F.col("l_quantity") % 19).cast("long").alias("few"))
    out = sc.distinct_values(items, "file", [c for c in items.columns if c != "file"])
    return out.select("file", "column", "n_distinct", F.concat_ws(",", "values").alias("values"))


QUERIES = {f.__name__: f for f in (signals_read, graph_paths, cluster_test, rfe_selected, ridge_grid, lda_scores, phase_native, config_issues, config_verdicts, categorical_columns, column_values)}


def _of(key: str, *names: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} AS BIGINT) % {len(names)} + 1]"


def _known(rule: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in va.CHOICES[rule][2]) + ")"


_COUNTED = "SELECT file, '{0}' AS \"column\", count(DISTINCT {0}) AS n, string_agg(DISTINCT CAST({0} AS VARCHAR), ',' ORDER BY CAST({0} AS VARCHAR)) AS v FROM i GROUP BY 1"

CONFIG = f"""c AS (SELECT o_orderkey AS id, o_orderkey % 5 AS l, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 END AS h, {_of('o_orderkey', 'infomax', 'picard', 'fastica', 'jade')} AS ica, o_orderkey % 9 - 3 AS z, CASE o_orderkey % 3 WHEN 0 THEN -2 WHEN 1 THEN -3 END AS b0, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS b1,
    {_of('o_orderkey // 2', 'dSPM', 'LCMV', 'beam')} AS source, ['plv', {_of('o_orderkey', 'pli', 'dwpli')}, {_of('o_orderkey // 3', 'wpli', 'aec')}] AS methods, {_of('o_orderkey', 'within_subject', 'between_group', 'other')} AS kind, {_of('o_orderkey // 5', 'kfold', 'loo')} AS cv FROM orders WHERE o_orderkey % 97 <> 0),
  ci AS (SELECT o_orderkey AS id, 'document' AS rule, 'error' AS severity, '$' AS place, NULL AS detail FROM orders WHERE o_orderkey % 97 = 0
    UNION ALL SELECT id, 'frequency_order', 'error', '$.preprocessing', l || '.0 ' || h || '.0' FROM c WHERE l >= h UNION ALL SELECT id, 'ica_method', 'error', '$.preprocessing.ica_method', ica FROM c WHERE ica NOT IN {_known('ica_method')}
    UNION ALL SELECT id, 'epoch_order', 'error', '$.epochs', '-2.0 ' || z || '.0' FROM c WHERE -2 >= z UNION ALL SELECT id, 'baseline_window', 'warning', '$.epochs.baseline', b0 || '.0 ' || b1 || '.0' FROM c WHERE b0 < -2 OR b1 > z
    UNION ALL SELECT id, 'source_method', 'error', '$.source.method', source FROM c WHERE source NOT IN {_known('source_method')} UNION ALL SELECT * FROM (SELECT id, 'connectivity_method', 'warning', '$.connectivity.methods', unnest(methods) AS m FROM c) WHERE m NOT IN {_known('connectivity_method')}
    UNION ALL SELECT id, 'prediction_type', 'error', '$.prediction.prediction_type', kind FROM c WHERE kind NOT IN {_known('prediction_type')} UNION ALL SELECT id, 'cv_strategy', 'error', '$.prediction.cv_strategy', cv FROM c WHERE cv NOT IN {_known('cv_strategy')})"""

ORACLE = {
    "signals_read": f"WITH {SIG} SELECT rec_id, CAST(channel AS INT) AS channel, CAST({SFREQ} AS DOUBLE) AS sfreq, count(*) AS n, round(max(sample_idx) / {SFREQ}, 6) AS last, round(sum(value * sample_idx), 5) AS weighted, round(min(value), 6) AS least FROM sig GROUP BY 1, 2",
    "graph_paths": f"""WITH RECURSIVE {SIG}, e AS (SELECT a.rec_id, a.channel AS i, b.channel AS j FROM sig a JOIN sig b ON a.rec_id = b.rec_id AND a.sample_idx = b.sample_idx AND a.channel < b.channel GROUP BY 1, 2, 3 HAVING corr(a.value, b.value) > {LINKED}),
      l AS (SELECT rec_id, i AS a, j AS b FROM e UNION ALL SELECT rec_id, j, i FROM e), w(rec_id, s, t, d) AS (SELECT rec_id, a, b, 1 FROM l UNION SELECT w.rec_id, w.s, l.b, w.d + 1 FROM w JOIN l ON l.rec_id = w.rec_id AND l.a = w.t WHERE w.d < 30),
      p AS (SELECT rec_id, s, t, min(d) AS d FROM w WHERE s <> t GROUP BY 1, 2, 3), q AS (SELECT rec_id, count(*) AS m, sum(d) AS total, max(d) AS longest FROM p GROUP BY 1), n AS (SELECT rec_id, count(DISTINCT channel) AS n FROM sig GROUP BY 1)
      SELECT rec_id, n AS n_nodes, coalesce(m, 0) AS n_joined, coalesce(m, 0) = n * (n - 1) AS connected, CASE WHEN coalesce(m, 0) = n * (n - 1) THEN round(total / (n * (n - 1)), 6) END AS mean_distance, CAST(longest AS BIGINT) AS longest FROM n LEFT JOIN q USING (rec_id)""",
    "phase_native": f"""WITH {SIG}, taps AS (SELECT unnest(range(0, {len(QUADRATURE[0])})) - {len(QUADRATURE[0]) // 2} AS o, unnest({QUADRATURE[0]}) AS hr, unnest({QUADRATURE[1]}) AS hi),
      place AS (SELECT s.rec_id, channel, sample_idx, hr, hi, n, sample_idx - o AS q FROM sig s JOIN len USING (rec_id), taps),
      z AS (SELECT p.rec_id, p.channel, p.sample_idx, sum(hr * x.value) AS re, sum(hi * x.value) AS im FROM place p JOIN sig x ON x.rec_id = p.rec_id AND x.channel = p.channel AND x.sample_idx = CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END GROUP BY 1, 2, 3),
      c AS (SELECT a.rec_id, a.channel AS i, b.channel AS j, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, sqrt(a.re * a.re + a.im * a.im) AS ea, sqrt(b.re * b.re + b.im * b.im) AS eb FROM z a JOIN z b ON a.rec_id = b.rec_id AND a.sample_idx = b.sample_idx AND a.channel < b.channel)
      SELECT rec_id, CAST(i AS INT) AS roi_i, CAST(j AS INT) AS roi_j, round(sqrt(pow(avg(re / sqrt(re * re + im * im)), 2) + pow(avg(im / sqrt(re * re + im * im)), 2)), 5) AS plv, round(abs(avg(CASE WHEN abs(im) > 1e-9 * sqrt(re * re + im * im) THEN sign(im) ELSE 0 END)), 5) AS pli, round(abs(avg(im)) / avg(abs(im)), 5) AS wpli,
        coalesce(nullif(round((pow(sum(im), 2) - sum(im * im)) / (pow(sum(abs(im)), 2) - sum(im * im)), 5), 0), 0) AS dwpli, coalesce(nullif(round(corr(ea, eb), 5), 0), 0) AS aec FROM c GROUP BY 1, 2, 3""",
    "cluster_test": f"""WITH v AS (SELECT vec_id // 25 AS s, vec_id % 25 AS t, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS v FROM embeddings),
      f AS (SELECT p, s, t, v, CASE WHEN p = 0 OR substr(md5('0:' || p || ':' || s), 1, 1) < '8' THEN 1 ELSE -1 END AS g FROM v, range({PERMUTATIONS + 1}) r(p)),
      m AS (SELECT p, t, count(*) AS n, sum(g * v) / count(*) AS mean, sum(v * v) AS q FROM f GROUP BY 1, 2), z AS (SELECT p, t, mean / (sqrt((q - n * mean * mean) / (n - 1)) / sqrt(n)) AS z FROM m),
      b AS (SELECT *, z > 0 AS positive, t - row_number() OVER (PARTITION BY p, z > 0 ORDER BY t) AS run FROM z WHERE abs(z) > {BEYOND}), c AS (SELECT p, positive, min(t) AS start, max(t) AS stop, sum(abs(z)) AS mass FROM b GROUP BY p, positive, run),
      x AS (SELECT p, max(mass) AS most FROM c GROUP BY 1)
      SELECT positive, start, stop, round(mass, 6) AS mass, round((SELECT count(*) FROM x WHERE most >= mass - 1e-9) / {PERMUTATIONS + 1}, 6) AS p FROM c WHERE c.p = 0""",
    "rfe_selected": """WITH g AS (SELECT ascii(l_returnflag) * 256 + ascii(l_linestatus) AS "group", count(*) AS n, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c, corr(l_quantity, l_extendedprice) AS x, corr(l_discount, l_extendedprice) AS y, corr(l_tax, l_extendedprice) AS z FROM lineitem GROUP BY 1),
      d AS (SELECT "group", 1 + 1.0 / n AS o, a, b, c, x, y, z FROM g),
      three AS (SELECT *, abs(x * (o * o - c * c) - a * (y * o - c * z) + b * (y * c - o * z)) AS q1, abs(o * (y * o - c * z) - x * (a * o - c * b) + b * (a * z - y * b)) AS q2, abs(o * (o * z - y * c) - a * (a * z - y * b) + x * (a * c - o * b)) AS q3 FROM d),
      first AS (SELECT *, CASE WHEN q1 <= q2 AND q1 <= q3 THEN 1 WHEN q2 <= q3 THEN 2 ELSE 3 END AS gone FROM three),
      two AS (SELECT "group", gone, CASE WHEN gone = 1 THEN CASE WHEN abs(o * y - c * z) <= abs(o * z - c * y) THEN 2 ELSE 3 END WHEN gone = 2 THEN CASE WHEN abs(o * x - b * z) <= abs(o * z - b * x) THEN 1 ELSE 3 END ELSE CASE WHEN abs(o * x - a * y) <= abs(o * y - a * x) THEN 1 ELSE 2 END END AS next FROM first)
      SELECT CAST("group" AS BIGINT) AS "group", f AS feature, CAST(CASE WHEN k = gone THEN 3 WHEN k = next THEN 2 ELSE 1 END AS BIGINT) AS "rank" FROM two, (VALUES (1, 'l_quantity'), (2, 'l_discount'), (3, 'l_tax')) t(k, f)""",
    "ridge_grid": f"""WITH d AS (SELECT l_orderkey % 5 AS f, l_quantity AS a, l_tax AS b, l_extendedprice / 1000 AS y FROM lineitem), k AS (SELECT DISTINCT f FROM d),
      m AS (SELECT k.f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS c, covar_pop(a, y) / stddev_pop(a) AS ya, covar_pop(b, y) / stddev_pop(b) AS yb FROM k JOIN d ON d.f <> k.f GROUP BY 1),
      w AS (SELECT *, alpha, n * ((n + alpha) * ya - n * c * yb) / ((n + alpha) * (n + alpha) - n * c * n * c) / sa AS wa, n * ((n + alpha) * yb - n * c * ya) / ((n + alpha) * (n + alpha) - n * c * n * c) / sb AS wb FROM m, unnest({list(ALPHAS)}) u(alpha)),
      e AS (SELECT w.f, CAST(alpha AS DOUBLE) AS alpha, y, y - my - wa * (a - ma) - wb * (b - mb) AS e FROM w JOIN d ON d.f = w.f)
      SELECT f AS fold, alpha, count(*) AS n, round(avg(e * e), 5) AS mse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 5) AS r2 FROM e GROUP BY 1, 2""",
    "lda_scores": """WITH s AS (SELECT ascii(l_returnflag) AS label, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(y) * count(*) AS yy, covar_pop(x, y) * count(*) AS xy FROM s GROUP BY 1),
      w AS (SELECT sum(n) AS n, sum(xx) / (sum(n) - count(*)) AS a, sum(yy) / (sum(n) - count(*)) AS d, sum(xy) / (sum(n) - count(*)) AS b FROM m),
      c AS (SELECT m.label AS k, (d * mx - b * my) / (a * d - b * b) AS cx, (a * my - b * mx) / (a * d - b * b) AS cy, mx, my, ln(m.n / w.n) AS prior FROM m, w),
      z AS (SELECT label, x, y, max(struct_pack(score := cx * x + cy * y + prior - (cx * mx + cy * my) / 2, k := k)) AS best FROM (SELECT *, row_number() OVER () AS id FROM s), c GROUP BY id, label, x, y)
      SELECT CAST(label AS BIGINT) AS label, CAST(best.k AS BIGINT) AS predicted, count(*) AS n, round(avg(best.score), 6) AS score FROM z GROUP BY 1, 2""",
    "config_issues": f"""WITH {CONFIG}, p AS (SELECT o_orderkey AS id, '/p' || (o_orderkey % 10) AS root, o_orderkey AS k FROM orders), rooted AS (SELECT * FROM p WHERE root IN (SELECT '/p' || (o_orderkey % 10) FROM orders WHERE o_orderkey % 10 < 8))
      SELECT * FROM ci UNION ALL SELECT id, 'no_root', 'error', 'root', root FROM p WHERE root NOT IN (SELECT root FROM rooted) UNION ALL SELECT id, 'no_subjects', 'warning', 'subjects', NULL FROM rooted WHERE k % 6 = 0
      UNION ALL SELECT id, 'no_sessions', 'warning', 'a', NULL FROM rooted WHERE k % 6 <> 0 AND k % 4 = 0 UNION ALL SELECT id, 'no_sessions', 'warning', 'b', NULL FROM rooted WHERE k % 6 <> 0 AND k % 5 = 0
      UNION ALL SELECT id, 'no_file', 'error', 'a/01/1', root || '/' || k || '.edf' FROM rooted WHERE k % 6 <> 0 AND k % 4 <> 0 AND k % 2 = 1""",
    "config_verdicts": f"""WITH {CONFIG}, n AS (SELECT id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM ci GROUP BY 1)
      SELECT o_orderkey AS id, coalesce(e, 0) = 0 AS "valid", coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings FROM orders LEFT JOIN n ON id = o_orderkey""",
    "categorical_columns": """WITH i AS (SELECT user_id % 40 AS file, event_type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 AS side FROM events), c AS (""" + " UNION ALL ".join(_COUNTED.format(x) for x in ("event_type", "user_id", "value", "k", "side")) + """)
      SELECT "column", "column" = 'event_type' OR count(*) FILTER (n < 20) > 0 AS categorical, count(*) FILTER (n > 0) AS files, count(*) FILTER (n < 20) AS few FROM c GROUP BY 1""",
    "column_values": "WITH i AS (SELECT l_suppkey % 10 AS file, l_returnflag, l_linestatus, l_linenumber, l_partkey, CAST(l_quantity % 21 AS BIGINT) AS many, CAST(l_quantity % 19 AS BIGINT) AS few FROM lineitem), c AS (" + " UNION ALL ".join(_COUNTED.format(x) for x in ("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "many", "few")) + """)
      SELECT CAST(file AS VARCHAR) AS file, "column", CASE WHEN n < 20 THEN n END AS n_distinct, CASE WHEN n < 20 THEN coalesce(v, '') ELSE '' END AS "values" FROM c""",
}
