"""Edge-selection prediction, metrics, permutation tests and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _moments(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count("*").cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]


def _corr(p: str = "") -> Column:
    n, sx, sy, sxx, syy, sxy = (F.col(p + m) for m in MOMENTS)
    vx, vy = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n)
    return F.when((vx > 1e-18) & (vy > 1e-18), (sxy / n - sx / n * sy / n) / F.sqrt(vx * vy))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d)
        c = 1 + k / c
        out *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-tailed p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def critical_r(n: int, alpha: float) -> float:
    """The correlation of n pairs at which the two-tailed p equals alpha."""
    lo, hi = 0.0, 1 - 1e-12
    for _ in range(200):
        r = (lo + hi) / 2
        lo, hi = (r, hi) if t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) > alpha else (lo, r)
    return hi


def edge_correlations(x: DataFrame, keys: list[str] = ()) -> DataFrame:
    """edge_id, n, r from (edge_id, value, target); NULL for constant edges, which are never selected."""
    return x.groupBy(*keys, "edge_id").agg(*_moments("value", "target")).select(*keys, "edge_id", F.col("n").cast("long").alias("n"), _corr().alias("r"))


def select_edges(corr: DataFrame, r_crit: float | Column) -> DataFrame:
    """Selected edges with tail 'pos' or 'neg'."""
    return corr.filter(F.abs("r") > r_crit).withColumn("tail", F.when(F.col("r") > 0, "pos").otherwise("neg"))


def cross_validate(x: DataFrame, r_crit: float) -> DataFrame:
    """fold, subject_id, target, prediction of edge-selection models, all folds at once.

    x: subject_id, edge_id, value, target, fold. Moments by fold and edge are added up, and a
    fold's training moments are the total without its own: the data are read once for selection,
    not once a fold. Network strength is a sum over selected edges; a one-variable regression for
    each tail predicts, and the prediction is the mean of the tails, 0 where none has edges.
    """
    m = x.groupBy("fold", "edge_id").agg(*_moments("value", "target"))
    every = W.partitionBy("edge_id")
    train = m.select("fold", "edge_id", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in MOMENTS])
    mask = select_edges(train.withColumn("r", _corr()), r_crit).select(F.col("fold").alias("k"), "edge_id", "tail")
    strength = x.join(mask, "edge_id").groupBy("k", "tail", "subject_id").agg(F.sum("value").alias("s"), F.first("target").alias("target"), F.first("fold").alias("fold"))
    line = strength.filter("fold <> k").groupBy("k", "tail").agg(F.regr_slope("target", "s").alias("a"), F.regr_intercept("target", "s").alias("b"))
    tails = strength.filter("fold = k").join(line, ["k", "tail"]).groupBy("subject_id").agg(F.avg(F.col("a") * F.col("s") + F.col("b")).alias("prediction"))
    people = x.select("subject_id", "target", "fold").distinct()
    return people.join(tails, "subject_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def regression_metrics(df: DataFrame, keys: list[str], truth: str, prediction: str) -> DataFrame:
    y, p = F.col(truth), F.col(prediction)
    d = y - p
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.var_pop(y).alias("_v"),
        F.try_divide(F.covar_pop(y, p), F.nullif(F.stddev_pop(y) * F.stddev_pop(p), F.lit(0.0))).alias("pearson"),
    )
    r2 = F.when(F.col("_v") > 0, 1 - F.try_divide("mse", F.nullif("_v", F.lit(0.0)))).otherwise(0.0)
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2).drop("_v")


def classification_metrics(df: DataFrame, truth: str, prediction: str, score: str | None = None) -> DataFrame:
    """Binary metrics, 0 where undefined; AUC from ranks by distinct score, so ties share theirs."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    out = df.agg(*[F.count_if(c).alias(name) for name, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    out = out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    if score is None:
        return out
    auc = _area(df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("n")))
    return out.join(F.broadcast(auc))  # one row


def _area(by: DataFrame, buckets: int = 256) -> DataFrame:
    """auc from (s, p, n), one row a distinct score: positives times the negatives below, ties half.

    Scores are cut into buckets at approximate quantiles; negatives are summed inside each bucket in
    order, and over whole buckets before, so no task orders all scores.
    """
    cuts = sorted(set(by.approxQuantile("s", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    rows = by.withColumn("b", F.size(F.filter(edges, lambda e: e < F.col("s"))))
    whole = rows.groupBy("b").agg(F.sum("n").alias("k"))
    before = whole.select("b", F.coalesce(F.sum("k").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(W.partitionBy("b").orderBy("s")) - F.col("n") / 2
    placed = rows.withColumn("inside", inside).join(F.broadcast(before), "b")  # one row a bucket
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("before") + F.col("inside"))), F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def summarise_folds(folds: DataFrame, metrics: list[str]) -> DataFrame:
    long = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("_m")).select("_m.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def rank_models(scores: DataFrame, model: str, score: str) -> DataFrame:
    """All pairs of models, the better first, with their ranks and difference; a table of models is small."""
    ranked = scores.select(model, score, F.row_number().over(W.orderBy(F.desc(score), model)).alias("rank"))
    a = ranked.select(F.col(model).alias("better"), F.col(score).alias("_a"), F.col("rank").alias("rank_better"))
    b = ranked.select(F.col(model).alias("worse"), F.col(score).alias("_b"), F.col("rank").alias("rank_worse"))
    return a.join(F.broadcast(b), F.col("rank_better") < F.col("rank_worse")).select("better", "worse", "rank_better", "rank_worse", (F.col("_a") - F.col("_b")).alias("difference"))


def seeded(key: Column, seed: Column | str) -> Column:
    """Text that orders rows at random, the same everywhere, by seed and key."""
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws(":", seed, key.cast("string")))


def positions(df: DataFrame, keys: list[str], order: Column, tie: str) -> DataFrame:
    """df with _i, the place from 1 of each row by a hexadecimal hash inside its keys.

    Rows are counted by the first digits of the hash, which gives where each such bucket starts, and
    numbered inside their bucket only, so no task orders all rows.
    """
    rows = df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 4))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_k")).drop("_k")
    placed = rows.join(before, [*keys, "_b"])
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_o", tie))
    return placed.withColumn("_i", F.col("_before") + inside).drop("_o", "_b", "_before")


def permutation_test(df: DataFrame, subject: str, x: str, y: str, n: int) -> DataFrame:
    """observed, p, null_mean, null_std of the correlation of x with y: p is the share of shuffles at least as large.

    Each shuffle re-pairs by position: subjects in one hashed order against subjects in another.
    """
    own = positions(df.select(subject, x), [], seeded(F.col(subject), "own"), subject).select("_i", F.col(x).alias("_x"))
    perms = df.select(subject, y).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    other = positions(perms, ["perm"], seeded(F.col(subject), F.col("perm")), subject).select("perm", "_i", F.col(y).alias("_y"))
    null = other.join(own, "_i").groupBy("perm").agg(*_moments("_x", "_y")).select(_corr().alias("r"))
    seen = df.agg(*_moments(x, y)).select(_corr().alias("observed"))
    return null.join(F.broadcast(seen)).groupBy("observed").agg(  # one row
        F.avg((F.abs("r") >= F.abs("observed")).cast("double")).alias("p"), F.avg("r").alias("null_mean"), F.stddev_pop("r").alias("null_std"),
    )


def split_subjects(subjects: DataFrame, subject: str, test: float, validation: float, seed: str = "42") -> DataFrame:
    """subject, split: int(n * ratio) for test, then validation, the rest trains; subjects in hashed order."""
    n = subjects.count()
    a, b = int(n * test), int(n * validation)
    i = F.col("_i")
    placed = positions(subjects.select(subject), [], seeded(F.col(subject), seed), subject)
    return placed.select(subject, F.when(i <= a, "test").when(i <= a + b, "validation").otherwise("train").alias("split"))


def macro_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """accuracy and the means over classes of precision, recall and F1, 0 where undefined.

    Classes are those of truth or prediction; counts of pairs of classes are all that is shuffled.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"))))
    sums = pairs.select(side.alias("_x")).groupBy("_x.label").agg(F.sum("_x.true").alias("true"), F.sum("_x.said").alias("said"))
    hits = pairs.filter("t = p").select(F.col("t").alias("label"), F.col("n").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    per = sums.join(hits, "label", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return per.agg(
        F.count("*").alias("n_classes"), ratio(F.sum("hit"), F.sum("true")).alias("accuracy"),
        F.avg(ratio(F.col("hit"), F.col("said"))).alias("precision"), F.avg(ratio(F.col("hit"), F.col("true"))).alias("recall"), F.avg(ratio(2 * F.col("hit"), F.col("true") + F.col("said"))).alias("f1"),
    )
