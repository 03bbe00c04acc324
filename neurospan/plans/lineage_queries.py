"""Queries over dependencies and version histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.operators import lineage as ln
from neurospan.operators import paths as pa
from neurospan.sources.tables import table

CHAINS = 200


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts depend on the parts at a third and a fifth of their key; of every 97th part on the next one, and back."""
    key = F.col("p_partkey")
    more = F.when(key % 97 == 0, F.array(key + 1)).when(key % 97 == 1, F.array(key - 1)).when(key % 89 == 0, F.array(key)).otherwise(F.array().cast("array<bigint>"))
    targets = F.concat(F.array(F.floor(key / 3), F.floor(key / 5)), more)
    return table(spark, sf_dir, "part").select(key.alias("source"), F.explode(targets).alias("target")).filter("target > 0")


def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with all it depends on, and whether the part lies on a cycle."""
    pairs = ln.closure(_edges(spark, sf_dir))
    on_cycle = ln.cyclic(pairs).select(F.col("node").alias("source"), F.lit(True).alias("_c"))
    return pairs.join(on_cycle, "source", "left").select("source", "target", F.col("steps").cast("long").alias("steps"), F.coalesce("_c", F.lit(False)).alias("cyclic"))


def version_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions in chains of hundreds; some chains bite their tail, some begin with a version that is its own parent."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), (F.col("o_custkey") % CHAINS).alias("chain"))
    ends = orders.groupBy("chain").agg(F.min("version").alias("first"), F.max("version").alias("last"))
    before = F.expr("lag(version) OVER (PARTITION BY chain ORDER BY version)")
    parent = F.when(F.col("version") != F.col("first"), before).when(F.col("chain") % 10 == 3, F.col("last")).when(F.col("chain") % 10 == 7, F.col("version"))
    return ln.lineage(orders.join(ends, "chain").select("version", parent.alias("parent")))


def version_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions of one another: all ancestors of each."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)").alias("parent"))
    return ln.ancestors(orders)


def dependency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stage configurations of runs; lineitems are the outputs there are."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    pick = lambda m, *names: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    depends = F.map_from_arrays(F.array(F.lit("task"), pick(5, "preprocessing", "preprocessing", "epochs", "features", "odd"), F.when(k % 5 > 1, "preprocessing").otherwise("note"), F.when(k % 15 == 3, "source").otherwise("more")), F.array(F.lit("rest"), pick(3, "standard", "strict", "v1"), F.lit("standard"), F.lit("dspm")))
    configs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), pick(2, "epochs", "preprocessing").alias("stage"), pick(4, "v1", "standard", "v2", "strict").alias("name"), F.map_filter(depends, lambda s, v: ~s.isin("note", "more")).alias("depends_on"),
        F.concat(F.lit("sub-"), text(F.col("o_custkey"))).alias("subject"), F.when(k % 7 != 0, "01").alias("session"), F.when(k % 11 == 0, "").otherwise("rest").alias("task"), text(k % 4).alias("run"))
    of = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    lead = F.concat(F.lit("sub-"), text(F.col("o_custkey")), F.lit("/ses-01"))
    outputs = of.select(F.explode(F.array(
        F.concat(F.lit("preprocessing/strict/"), lead, F.lit("/task-rest/run-"), text(k % 4)), F.concat(F.lit("epochs/standard/rest/"), lead), F.lit("features/standard/rest/variant-dspm/standard"))).alias("path"))
    out = ln.resolve(configs, outputs)
    return out.select("o_orderkey", "dependency", "variant", "path", F.concat_ws(",", "needs").alias("needs"), "found", "problem")


def path_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: where their outputs lie, and how their files are named."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    of = {"subject": F.concat(F.when(k % 3 == 0, "sub-").otherwise(""), text(F.col("o_custkey"))), "session": text(k % 4), "task": F.lit("rest"), "run": F.when(k % 5 != 0, text(k % 5)), "pipeline": F.lit("standard"), "preprocessing": F.lit("standard"), "variant": F.when(k % 2 == 0, "variant-a").otherwise("b"), "feature": F.lit("conn"), "model": F.lit("ridge"), "stage": F.lit("epochs")}
    places = [pa.place(name, **of).alias(name) for name in pa.FOLDERS]
    name = pa.file_name(of["subject"], of["session"], of["task"], of["run"], F.when(k % 7 == 0, "clean").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", *places, name.alias("file"))


QUERIES = {f.__name__: f for f in (dependency_closure, version_lineage, version_ancestors, dependency_resolution, path_catalogue)}

_K = "[{}][CAST(o_orderkey % {} AS BIGINT) + 1]"


def _pick(*names: str) -> str:
    return _K.format(", ".join(f"'{n}'" for n in names), len(names))


ORACLE = {
    "dependency_closure": """WITH RECURSIVE e AS (SELECT p_partkey AS source, unnest([p_partkey // 3, p_partkey // 5] || CASE WHEN p_partkey % 97 = 0 THEN [p_partkey + 1] WHEN p_partkey % 97 = 1 THEN [p_partkey - 1] WHEN p_partkey % 89 = 0 THEN [p_partkey] ELSE [] END) AS target FROM part),
      edge AS (SELECT DISTINCT source, target FROM e WHERE target > 0),
      walk(source, target, steps) AS (SELECT source, target, 1 FROM edge UNION SELECT w.source, edge.target, w.steps + 1 FROM walk w JOIN edge ON edge.source = w.target WHERE w.steps < 24),
      pair AS (SELECT source, target, CAST(min(steps) AS BIGINT) AS steps FROM walk GROUP BY 1, 2)
      SELECT *, source IN (SELECT source FROM pair WHERE source = target) AS cyclic FROM pair""",
    "version_lineage": f"""SELECT o_orderkey AS version, CASE WHEN NOT c THEN root END AS root, CASE WHEN NOT c THEN depth END AS depth, c AS cyclic
      FROM (SELECT o_orderkey, o_custkey % {CHAINS} % 10 IN (3, 7) AS c, min(o_orderkey) OVER w AS root, row_number() OVER (w ORDER BY o_orderkey) - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey % {CHAINS}))""",
    "version_ancestors": """WITH n AS (SELECT o_orderkey AS v, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT a.v AS version, b.v AS ancestor, a.k - b.k AS distance FROM n a JOIN n b ON a.c = b.c AND b.k < a.k""",
    "dependency_resolution": f"""WITH c AS (SELECT o_orderkey, {_pick('epochs', 'preprocessing')} AS stage, {_pick('v1', 'standard', 'v2', 'strict')} AS name, {_pick('preprocessing', 'preprocessing', 'epochs', 'features', 'odd')} AS d1, {_pick('standard', 'strict', 'v1')} AS v1,
        'sub-' || o_custkey AS subject, CASE WHEN o_orderkey % 7 <> 0 THEN '01' END AS session, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'rest' END AS task, CAST(o_orderkey % 4 AS VARCHAR) AS run, CASE WHEN o_orderkey % 5 > 1 THEN 'standard' ELSE v1 END AS pre, CASE WHEN o_orderkey % 15 = 3 THEN 'dspm' END AS src FROM orders),
      d AS (SELECT *, 'task' AS dependency, 'rest' AS variant FROM c UNION ALL SELECT *, d1, v1 FROM c UNION ALL SELECT *, 'preprocessing', 'standard' FROM c WHERE o_orderkey % 5 > 1 UNION ALL SELECT *, 'source', 'dspm' FROM c WHERE o_orderkey % 15 = 3),
      n AS (SELECT *, concat_ws(',', CASE WHEN dependency IN ('preprocessing', 'epochs', 'source') AND subject IS NULL THEN 'subject' END, CASE WHEN dependency IN ('preprocessing', 'epochs', 'source') AND session IS NULL THEN 'session' END,
          CASE WHEN dependency IN ('preprocessing', 'epochs', 'source', 'features') AND task = '' THEN 'task' END, CASE WHEN dependency = 'features' AND src IS NULL THEN 'source' END) AS needs FROM d),
      p AS (SELECT *, CASE WHEN needs <> '' THEN NULL WHEN dependency = 'preprocessing' THEN 'preprocessing/' || variant || '/' || subject || '/ses-' || session || '/task-' || task || '/run-' || run WHEN dependency = 'epochs' THEN 'epochs/' || pre || '/' || task || '/' || subject || '/ses-' || session
          WHEN dependency = 'source' THEN 'source/' || pre || '/' || task || '/variant-' || variant || '/' || subject || '/ses-' || session WHEN dependency = 'features' THEN 'features/' || pre || '/' || task || '/variant-' || src || '/' || variant END AS path FROM n),
      o AS (SELECT DISTINCT unnest(['preprocessing/strict/sub-' || o_custkey || '/ses-01/task-rest/run-' || (o_orderkey % 4), 'epochs/standard/rest/sub-' || o_custkey || '/ses-01', 'features/standard/rest/variant-dspm/standard']) AS path FROM orders WHERE o_orderstatus <> 'F')
      SELECT o_orderkey, dependency, variant, path, needs, dependency = 'task' OR o.path IS NOT NULL AS found,
        CASE WHEN dependency = 'task' THEN NULL WHEN dependency = 'odd' THEN 'unknown' WHEN dependency = stage AND variant = name THEN 'itself' WHEN needs <> '' THEN 'incomplete' WHEN o.path IS NULL THEN 'missing' END AS problem
      FROM p LEFT JOIN o USING (path)""",
    "path_catalogue": """WITH r AS (SELECT o_orderkey, 'sub-' || o_custkey AS s, 'ses-' || (o_orderkey % 4) AS e, CASE WHEN o_orderkey % 5 <> 0 THEN 'run-' || (o_orderkey % 5) END AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'variant-a' ELSE 'variant-b' END AS v FROM orders)
      SELECT o_orderkey, 'preprocessing/standard/' || s || '/' || e || '/task-rest/' || r AS preprocessing, 'preprocessing/standard' AS preprocessing_root, 'epochs/standard/rest/' || s || '/' || e AS epochs, 'epochs/standard/rest' AS epochs_root, 'source/standard/rest/' || v || '/' || s || '/' || e AS source, 'source/standard/rest' AS source_root,
        'features/standard/rest/' || v || '/conn' AS features, 'features/standard/rest' AS features_root, 'prediction/ridge' AS prediction, 'pipeline-standard' AS legacy_outputs, s || '/' || e || '/eeg' AS recordings, 'pipelines/standard' AS legacy_pipeline, 'configs/epochs' AS configs,
        concat_ws('_', s, e, 'task-rest', r, CASE WHEN o_orderkey % 7 = 0 THEN 'desc-clean' END, 'eeg.fif') AS file FROM r""",
}
