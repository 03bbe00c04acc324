"""Mixing sources to target weights by Pareto order sampling.

What a source's target lacks after whole copies of everything is drawn document by document, with
inclusion in proportion to size: a document of s words is included with min(1, c * s), c such that
the expected words are those lacking. Certain documents get one more whole copy; the rest are ranked
by random odds over inclusion odds and taken in that order up to the words lacking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.llm.common import n_words, sent_if_small, stored, table, text_or_empty

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BUCKETS = 4096


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    The whole size is shared by weight (sources by code point, null last, the weights repeating); a
    target stops at max_copies times its source's size and the excess goes to the others by weight.
    Sorted by size over weight the capped sources come first; the level that each source would set
    with all before it at their caps falls from the first that stays below its own cap on, so the
    greatest such level is the right one.
    The windows without keys see one row per source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(max_copies)
    fill = W.orderBy(cap / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / weight)
    per = per.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= cap, F.col("_level"))).over(every))
    return per.select("source", "source_size", F.least(cap, F.col("_level") * F.col("_w")).alias("target"))


def with_inclusion(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """plan with _c, where a document's inclusion is min(1, _c * size), and _lack without the certain documents' words.

    Solved on counts by source and size: with the sizes above v certain, c is what is lacking over
    the squares of the rest, and the greatest v with c * v up to 1 is right, as c grows with each size
    that becomes certain. The windows see a row for each size that a source holds, never documents.
    """
    per = rows.groupBy("source", "size").agg(F.count("*").cast("double").alias("_n")).filter("size > 0")
    per = per.withColumnRenamed("source", "_s").join(sent_if_small(plan.select("_source", "_lack"), 100), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
    size = F.col("size").cast("double")
    up = W.partitionBy("_source").orderBy("size")
    down = W.partitionBy("_source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.col("_n") * size).over(down), F.lit(0.0))
    per = per.withColumn("_above", above).withColumn("_level", (F.col("_lack") - F.col("_above")) / F.sum(F.col("_n") * size * size).over(up))
    found = per.filter(F.col("_level") * size <= 1).groupBy("_source").agg(F.max_by(F.struct("_level", "_above"), "size").alias("_x"))
    found = found.select(F.col("_source").alias("_s"), F.greatest("_x._level", F.lit(0.0)).alias("_c"), F.col("_x._above").alias("_above"))
    joined = plan.join(found, plan["_source"].eqNullSafe(found["_s"]), "left").drop("_s")
    return joined.withColumn("_lack", F.col("_lack") - F.coalesce("_above", F.lit(0.0))).drop("_above")


def _ranked(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """rows with their source's plan, _pi, the rank _q of those not certain, and the rank's digits _b1, _b2, _b3.

    _b1 and _b2 are the first digits of _q / (1 + _q) to the base of buckets, _b3 is one of _tie,
    which tells rows apart that share everything else.
    """
    joined = rows.join(sent_if_small(plan, 200), rows["source"].eqNullSafe(plan["_source"])).drop("_source")
    joined = joined.withColumn("_pi", F.least(F.lit(1.0), F.coalesce("_c", F.lit(0.0)) * F.col("size")))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.nullif("_pi", F.lit(0.0)) / F.nullif(1 - F.col("_pi"), F.lit(0.0)))
    joined = joined.withColumn("_q", odds)
    x = F.col("_q") / (1 + F.col("_q")) * buckets
    joined = joined.withColumn("_b1", F.floor(x).cast("int"))
    return joined.withColumn("_b2", F.floor((x - F.col("_b1")) * buckets).cast("int")).withColumn("_b3", F.floor(F.col("_tie") * buckets).cast("int"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, buckets: int = BUCKETS) -> DataFrame:
    """One row per source: source_size, target, whole copies, inclusion, what is lacking, and the cut.

    rows has doc_id, source, size, _u and _tie. The cut is where the words drawn reach what is
    lacking: digit by digit of the rank, on sums by source and digit, each over the rows that share
    the digits before. So the last digit's rows, which are ordered one by one, are few however large
    a source is and however often a document is repeated.
    """
    plan = source_targets(rows, weights, max_copies)
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", F.floor(F.coalesce(ratio, F.lit(0.0))).cast("long").alias("_whole"))
    plan = stored(plan.withColumn("_lack", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-plan")
    plan = stored(with_inclusion(plan, rows), "mix-inclusion").withColumn("_before", F.lit(0.0))
    digits: list[str] = []
    for digit in ("_b1", "_b2", "_b3"):
        drawn = _ranked(rows, plan, buckets).filter("_q is not null")
        for d in digits:
            drawn = drawn.filter(F.col(d) == F.col(f"_cut{d}"))
        sums = drawn.groupBy("source", "_lack", "_before", digit).agg(F.sum("size").cast("double").alias("_sum"))
        run = W.partitionBy("source").orderBy(digit)
        sums = sums.withColumn("_start", F.col("_before") + F.sum("_sum").over(run) - F.col("_sum"))
        cut = sums.filter((F.col("_start") < F.col("_lack")) & (F.col("_lack") <= F.col("_start") + F.col("_sum")))
        cut = cut.groupBy("source").agg(F.min(digit).alias(f"_cut{digit}"), F.min("_start").alias("_start"))
        kept = [c for c in plan.columns if c != "_before"]
        plan = plan.join(cut.withColumnRenamed("source", "_s"), plan["_source"].eqNullSafe(F.col("_s")), "left")
        plan = stored(plan.select(*kept, f"_cut{digit}", F.coalesce("_start", "_before").alias("_before")), "mix-cut")
        digits.append(digit)
    return plan


def _cut_of(plan: DataFrame) -> tuple[Column, Column]:
    """A row's three digits and those of its source's cut."""
    digits = ("_b1", "_b2", "_b3")
    return F.struct(*digits), F.struct(*[F.coalesce(F.col(f"_cut{d}"), F.lit(-1)) for d in digits])


def edge_takes(rows: DataFrame, plan: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Which of the rows with all three digits of their source's cut are taken: these few are ordered one by one."""
    at, cut = _cut_of(plan)
    inside = W.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = _ranked(rows, plan, buckets).filter(F.col("_q").isNotNull() & (at == cut)).withColumn("_edge", before + F.col("size") / 2 < F.col("_lack"))
    return stored(edge.select(F.col("source").alias("_s"), F.col("doc_id").alias("_i"), F.col("_u").alias("_v"), F.col("_tie").alias("_t"), "_edge"), "mix-edge")


def pareto_mix(rows: DataFrame, plan: DataFrame, edge: DataFrame, max_copies: int = MAX_COPIES, buckets: int = BUCKETS) -> DataFrame:
    """rows (doc_id, source, size, _u, _tie, ...) with source_size, target, copies and taken added.

    A source's ratio of target to size gives every document its whole copies. What the target still
    lacks is drawn with inclusion in proportion to size; certain documents are taken, the others are
    ranked by u/(1-u) over their own inclusion odds and the first ones are taken until their words
    come nearest to what is lacking: a sample of fixed size. Rows before the cut are taken as they
    pass, those at the cut are looked up in edge, so no task sees a source.

    Null sizes count as 0; a document without words is never drawn; a source without words gets
    target 0; a null source is one source. Ties in rank go by doc_id. Columns of rows with the names
    that are added are replaced, and _u and _tie are dropped.
    """
    rows = rows.drop("source_size", "target", "copies", "taken").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    own = [c for c in rows.columns if c not in ("_u", "_tie")]
    at, cut = _cut_of(plan)
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_u") == F.col("_v")) & (F.col("_tie") == F.col("_t"))
    joined = _ranked(rows, plan, buckets).join(sent_if_small(edge, 100), same, "left")
    # a source without a cut lacks nothing or, by rounding, all that can be drawn
    drawn = F.col("_q").isNotNull() & F.when(F.col("_cut_b1").isNotNull(), at < cut).otherwise(F.col("_lack") > 0)
    take = F.coalesce("_edge", (F.col("_pi") >= 1) | drawn)
    copies = F.least(F.col("_whole") + take.cast("long"), F.lit(max_copies))
    return joined.select(*own, "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _lots(docs: DataFrame, seed: int = 0) -> list[Column]:
    """doc_id, source, size, the random number of a document (by id and text) and one of its row."""
    text = text_or_empty()
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text), *([F.lit(str(seed))] if seed else []))
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), uniform(key).alias("_u"), row.alias("_tie")]


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.select(*_lots(docs, seed))


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents that the mix takes, each as often as it does; no text is shuffled.

    docs should be a table: rows equal in id and text are told apart by their place in it.
    """
    sizes = stored(sized(docs), "mix-sizes")
    plan = mix_plan(sizes, weights)
    rows = docs.select(*_lots(docs), F.struct("*").alias("row"))
    # the row's number keeps the filter above the ranks, so they are made once
    mixed = pareto_mix(rows, plan, edge_takes(sizes, plan)).select("row", "copies", F.monotonically_increasing_id().alias("_n"))
    taken = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")


def op5_pareto_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken for every document; the size is its words."""
    rows = stored(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    plan = mix_plan(rows)
    return pareto_mix(rows, plan, edge_takes(rows, plan)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s
), v AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS v
  FROM w WINDOW f AS (ORDER BY source_size * 3.0::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, w * (SELECT max(v) FROM v WHERE v * w <= source_size * 3.0::DOUBLE)) AS target FROM v
), r AS (
  SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT) AS whole FROM t
), l AS (
  SELECT *, target - whole * source_size AS lack FROM r
), z AS (
  SELECT d.source, d.size, CAST(count(*) AS DOUBLE) AS n, any_value(lack) AS lack FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source WHERE size > 0 GROUP BY d.source, d.size
), y AS (
  SELECT *, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(n * size * size) OVER (PARTITION BY source ORDER BY size) AS squares FROM z
), x AS (
  SELECT source, greatest(arg_max((lack - above) / squares, size), 0) AS c, arg_max(above, size) AS above FROM y WHERE (lack - above) / squares * size <= 1 GROUP BY source
), q AS (
  SELECT d.doc_id, d.size, d.source, l.source_size, l.target, l.whole, l.lack - coalesce(x.above, 0) AS lack, least(1.0::DOUBLE, coalesce(x.c, 0) * d.size) AS pi,
         (CAST(('0x' || substr(md5(concat_ws(':', coalesce(CAST(d.doc_id AS VARCHAR), ''), md5(coalesce(d.text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
), o AS (
  SELECT *, CASE WHEN pi > 0 AND pi < 1 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM q
), k AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN pi >= 1 OR (q IS NOT NULL AND b + size / 2 < lack) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM k
"""
