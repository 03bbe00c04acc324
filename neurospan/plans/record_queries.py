"""Queries over record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import epochs as ep
from neurospan.operators import records as rc
from neurospan.operators import signal_qc as qc
from neurospan.plans.signal_queries import EPO, SIG, _epochs
from neurospan.sources.tables import signal_long, table

RAW = ["Eye blink", "muscle artifact", "Heart beat", "line noise", "channel Noise", "brain", "unsure"]


def component_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, RAW)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rc.component_label(pick).alias("label"), (F.col("l_quantity") / 50).alias("prob"))
    out = rc.reject_components(df, ["eye", "muscle", "heart"])
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"))


def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pheno = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").cast("string").alias("price"), F.max("o_orderstatus").alias("status"))
    out = rc.add_scores(table(spark, sf_dir, "customer").select("c_custkey"), pheno, "c_custkey", ["price", "status"])
    return out.select("c_custkey", F.size("scores").cast("long").alias("n_scores"), F.round(F.element_at("scores", "price"), 4).alias("price"))


def state_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = ev.agg(F.max("ts").alias("now"))
    return ev.join(F.broadcast(last)).select("event_id", rc.relative_age(F.col("ts"), F.col("now")).alias("age"))


def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", rc.escape_html(F.col("html")).alias("html"))


def import_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return rc.import_tally(table(spark, sf_dir, "orders").select(status.alias("status")), "status").select("total", "success", "failed", "skipped", F.round("rate", 6).alias("rate"))


def inclusion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_epochs"), (F.max("o_totalprice") < 450_000).alias("included"))
    return rc.inclusion(df, "included", "included", 5, text="1", column="o_custkey")


def block_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("x"))
    blocks = item.select("l_orderkey", F.col("x.l_quantity").alias("q"), F.slice("x.l_partkey", 1, 2).alias("p"))
    return rc.expand_blocks(blocks, ["l_orderkey"], {"duration": "q", "code": "p"}, F.lit(1.0)).select("l_orderkey", "trial", "duration", "code", "onset")


def condition_erp(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = ep.channel_mean(ep.erp(rc.well_sampled(_epochs(spark, sf_dir), 4)))
    return wave.select("condition", "t", F.round("value", 6).alias("value"))


def variance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = signal_long(spark, sf_dir)
    out = rc.compare_variance(signal, qc.rereference(signal))
    return out.select("channel", F.round(F.col("first") / 1e12, 6).alias("first"), F.round(F.col("second") / 1e12, 6).alias("second"))


def inclusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_epochs"), (F.max("o_totalprice") < 400_000).alias("included"))
    df = df.withColumn("site", F.col("o_custkey") % 5).withColumn("n_epochs", F.when(F.col("o_custkey") % 11 != 0, F.col("n_epochs")))
    return rc.inclusion_summary(df, "included", "n_epochs", "site").select("site", "total", "included", *[F.round(c, 6).alias(c) for c in ("percent", "mean_epochs")], "sum_epochs")


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and order statuses as sessions; urgent orders can't be read, customers in debt have no quality record."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("session"), F.col("o_orderpriority").alias("condition"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("subject"))
    return rc.epoch_batches(orders.filter("condition <> '1-URGENT'"), orders, orders.join(rich, "subject", "left_semi"), ["subject", "session"])


def behaviour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings of their customers, line items as triggers; each customer has a few behavioural files."""
    k = F.col("o_orderkey")
    recorded = table(spark, sf_dir, "orders").select(k.alias("recording"), F.col("o_custkey").alias("subject"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("paradigm"), F.concat(F.lit("task_BLOCK"), (F.floor(k / 3) % 4).cast("string")).alias("variant"))
    c = F.col("c_custkey")
    one = lambda paradigm, block: F.struct(paradigm.alias("paradigm"), block.alias("block"))
    p0, p1 = F.lit("p0"), F.lit("p1")
    files = F.array(one(p0, F.lit("Block1")), one(p0, F.lit("block2")), one(p1, F.when(c % 2 == 0, F.lit("Block3"))), one(p1, F.lit("Block0")), one(F.when(c % 3 == 0, "p2").otherwise("p9"), F.lit("")))
    behaviour = table(spark, sf_dir, "customer").select(c.alias("subject"), F.posexplode(files).alias("i", "x")).select("subject", "x.paradigm", "x.block", F.concat(F.lit("/b/"), F.col("subject").cast("string"), F.lit("/"), F.col("i").cast("string")).alias("path"))
    triggers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recording"), (F.col("l_linenumber") * F.lit(0.25) + F.col("l_partkey") % 7).cast("double").alias("time"), (F.col("l_suppkey") % 10).cast("int").alias("code"))
    starts = spark.range(6).select(F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("paradigm"), (F.col("id") + 2).cast("int").alias("code"))
    return rc.match_behaviour(recorded, behaviour, triggers, starts).select("recording", "file", "offset")


QUERIES = {f.__name__: f for f in (component_rules, subject_scores, state_age, escaped_names, import_tally, inclusion_list, block_trials, condition_erp, variance_compare, inclusion_summary, epoch_batches, behaviour_match)}

LABELS = "['eye', 'muscle', 'heart', 'line_noise', 'channel_noise', 'brain', 'other']"
ORACLE = {
    "component_rules": f"""WITH d AS (SELECT {LABELS}[l_orderkey % 7 + 1] AS label, l_quantity / 50 AS prob FROM lineitem)
      SELECT label, count(*) AS n, count(*) FILTER (label IN ('eye', 'muscle', 'heart') AND prob > 0.8) AS n_rejected FROM d GROUP BY 1""",
    "subject_scores": """WITH p AS (SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN price IS NULL THEN 0 ELSE 1 END AS n_scores, round(price, 4) AS price FROM customer LEFT JOIN p ON c_custkey = o_custkey""",
    "state_age": """WITH e AS (SELECT event_id, ts, epoch(date_trunc('second', max(ts) OVER ()))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM events), d AS (SELECT *, s // 86400 AS d, s // 3600 % 24 AS h, s // 60 % 60 AS m FROM e)
      SELECT event_id, CASE WHEN d = 1 THEN 'yesterday' WHEN d > 0 AND d < 7 THEN d || ' days ago' WHEN d > 0 THEN strftime(ts, '%Y-%m-%d') WHEN h > 0 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END || ' ago'
        WHEN m > 0 THEN m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END || ' ago' ELSE 'just now' END AS age FROM d""",
    "escaped_names": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM pages""",
    "import_tally": """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped,
      round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'O'), 6) AS rate FROM orders""",
    "inclusion_list": """SELECT o_custkey, count(*) AS n_epochs, max(o_totalprice) < 450000 AS included FROM orders GROUP BY 1 HAVING count(*) >= 5 AND max(o_totalprice) < 450000 AND contains(CAST(o_custkey AS VARCHAR), '1')""",
    "block_trials": """WITH x AS (SELECT l_orderkey, l_quantity, l_partkey, row_number() OVER w - 1 AS i, sum(l_quantity) OVER w - l_quantity AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey ROWS UNBOUNDED PRECEDING))
      SELECT l_orderkey, CAST(i AS INT) AS trial, l_quantity AS duration, CASE WHEN i < 2 THEN l_partkey END AS code, 1.0::DOUBLE + b AS onset FROM x""",
    "condition_erp": f"""WITH {EPO}, c AS (SELECT condition FROM ev GROUP BY 1 HAVING count(*) >= 4), w AS (SELECT condition, t, avg(value) AS v FROM erp WHERE condition IN (SELECT condition FROM c) GROUP BY ALL) SELECT condition, t, round(v, 6) AS value FROM w""",
    "variance_compare": f"""WITH {SIG}, a AS (SELECT channel, var_pop(value) AS v FROM sig GROUP BY 1), c AS (SELECT channel, value - avg(value) OVER (PARTITION BY rec_id, sample_idx) AS value FROM sig), b AS (SELECT channel, var_pop(value) AS v FROM c GROUP BY 1)
      SELECT CAST(coalesce(a.channel, b.channel) AS INT) AS channel, round(a.v, 6) AS "first", round(b.v, 6) AS "second" FROM a FULL JOIN b ON a.channel = b.channel""",
    "inclusion_summary": """WITH c AS (SELECT o_custkey % 5 AS site, CASE WHEN o_custkey % 11 <> 0 THEN count(*) ELSE 0 END AS n, max(o_totalprice) < 400000 AS i FROM orders GROUP BY o_custkey)
      SELECT site, count(*) AS total, count(*) FILTER (i) AS included, round(100 * count(*) FILTER (i) / count(*), 6) AS percent, round(avg(n), 6) AS mean_epochs, CAST(sum(n) AS BIGINT) AS sum_epochs FROM c GROUP BY 1""",
    "epoch_batches": """WITH o AS (SELECT o_custkey AS subject, nullif(o_orderstatus, 'P') AS session, o_orderpriority AS c FROM orders)
      SELECT subject, session, count(*) FILTER (c <> '1-URGENT') AS n_epochs, count(DISTINCT c) FILTER (c <> '1-URGENT') AS n_conditions, bool_or(subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS checked FROM o GROUP BY 1, 2""",
    "behaviour_match": """WITH r AS (SELECT o_orderkey AS recording, o_custkey AS subject, 'p' || (o_orderkey % 3) AS paradigm, 'task_block' || (o_orderkey // 3 % 4) AS variant FROM orders),
      b AS (SELECT c_custkey AS subject, x.p AS paradigm, lower(coalesce(x.b, '')) AS block, '/b/' || c_custkey || '/' || x.i AS path FROM (SELECT c_custkey, unnest([{'i': 0, 'p': 'p0', 'b': 'Block1'}, {'i': 1, 'p': 'p0', 'b': 'block2'}, {'i': 2, 'p': 'p1', 'b': CASE WHEN c_custkey % 2 = 0 THEN 'Block3' END}, {'i': 3, 'p': 'p1', 'b': 'Block0'}, {'i': 4, 'p': CASE WHEN c_custkey % 3 = 0 THEN 'p2' ELSE 'p9' END, 'b': ''}]) AS x FROM customer)),
      f AS (SELECT recording, min(path) AS file FROM r JOIN b USING (subject, paradigm) WHERE contains(variant, block) GROUP BY 1), t AS (SELECT l_orderkey AS recording, min(l_linenumber * 0.25 + l_partkey % 7) AS o FROM lineitem JOIN r ON l_orderkey = recording WHERE l_suppkey % 10 BETWEEN 2 AND 7 AND l_suppkey % 10 % 3 = (CAST(right(paradigm, 1) AS INT) + 2) % 3 GROUP BY 1)
      SELECT recording, file, CAST(coalesce(o, 0) AS DOUBLE) AS "offset" FROM r LEFT JOIN f USING (recording) LEFT JOIN t USING (recording)""",
}
