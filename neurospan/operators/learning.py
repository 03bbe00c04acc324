"""Models from pyspark.ml: a factory, pipelines with selection, grid search; elimination and discriminants from moments."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml import classification as cl
from pyspark.ml import evaluation as ev
from pyspark.ml import feature as fe
from pyspark.ml import regression as rg
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.operators.connectivity import pair_moments

#: Regularisation is scaled as Spark does, so strengths don't carry over from other libraries.
MODELS: dict[str, tuple[type, dict[str, Any]]] = {
    "linear": (rg.LinearRegression, {"regParam": 0.0}),
    "ridge": (rg.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.0}),
    "lasso": (rg.LinearRegression, {"regParam": 0.1, "elasticNetParam": 1.0}),
    "elasticnet": (rg.LinearRegression, {"regParam": 0.1, "elasticNetParam": 0.5}),
    "random_forest": (rg.RandomForestRegressor, {"numTrees": 100, "seed": 42}),
    "gradient_boosting": (rg.GBTRegressor, {"maxIter": 50, "seed": 42}),
    "logistic": (cl.LogisticRegression, {}),
    "svm": (cl.LinearSVC, {}),
}
GRIDS: dict[str, dict[str, list[Any]]] = {
    "ridge": {"regParam": [0.1, 1.0, 10.0]},
    "lasso": {"regParam": [0.01, 0.1, 1.0]},
    "elasticnet": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.2, 0.5, 0.8]},
    "random_forest": {"maxDepth": [3, 5, 10]},
    "logistic": {"regParam": [0.01, 0.1, 1.0]},
    "svm": {"regParam": [0.01, 0.1, 1.0]},
}


def model(name: str, label: str = "label", features: str = "features", **params: Any) -> Estimator:
    if name not in MODELS:
        raise ValueError(f"no model {name}; there are {sorted(MODELS)}")
    kind, defaults = MODELS[name]
    return kind(labelCol=label, featuresCol=features, **{**defaults, **params})


def pipeline(name: str, label: str = "label", features: str = "features", select: int | None = None, **params: Any) -> Pipeline:
    """Standardisation, selection of the best features one by one (if wanted), then the model."""
    stages: list[Any] = [fe.StandardScaler(inputCol=features, outputCol="_scaled", withMean=True)]
    column = "_scaled"
    if select:
        chooser = fe.UnivariateFeatureSelector(featuresCol=column, outputCol="_selected", labelCol=label, selectionMode="numTopFeatures")
        kind = "categorical" if MODELS[name][0].__module__.endswith("classification") else "continuous"
        stages.append(chooser.setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(select))
        column = "_selected"
    return Pipeline(stages=[*stages, model(name, label, column, **params)])


def grid_search(df: DataFrame, name: str, label: str = "label", features: str = "features", folds: int = 5, grid: dict[str, list[Any]] | None = None, parallelism: int = 4) -> CrossValidatorModel:
    whole = pipeline(name, label, features)
    last = whole.getStages()[-1]
    builder = ParamGridBuilder()
    for key, values in (grid or GRIDS.get(name, {})).items():
        builder.addGrid(last.getParam(key), values)
    classifies = MODELS[name][0].__module__.endswith("classification")
    judge = ev.BinaryClassificationEvaluator(labelCol=label) if classifies else ev.RegressionEvaluator(labelCol=label, metricName="r2")
    return CrossValidator(estimator=whole, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, seed=42, parallelism=parallelism).fit(df)


def eliminated(moments: pd.DataFrame, names: list[str], keep: int, alpha: float) -> list[tuple[str, int, float]]:
    """(feature, rank, coefficient) by backward elimination of a ridge regression, from moments alone.

    moments has the rows i, j, n, si, sj, sij of pair_moments, the target last. Features are standardised (population
    std; a constant one has coefficient 0). Leaving a feature out takes its row and column out of the
    inverse, so all rounds together cost what one inversion does. Rank 1 is kept; the feature that goes last has rank 2.
    """
    d = len(names)
    n = float(moments["n"].iloc[0])
    s, g = np.zeros(d + 1), np.zeros((d + 1, d + 1))
    i, j = moments["i"].to_numpy(), moments["j"].to_numpy()
    g[i, j] = g[j, i] = moments["sij"].to_numpy()
    diagonal = i == j
    s[i[diagonal]] = moments["si"].to_numpy()[diagonal]
    cov = g / n - np.outer(s, s) / n / n
    sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
    scale = np.where(sd > 1e-12, sd, np.inf)
    inverse = np.linalg.inv(n * cov[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d))
    right = n * cov[:d, d] / scale
    left, ranks = list(range(d)), np.ones(d, int)
    for rank in range(d, keep, -1):
        coefficients = inverse @ right[left]
        worst = int(np.argmin(np.abs(coefficients)))
        ranks[left.pop(worst)] = rank - keep + 1
        inverse = inverse - np.outer(inverse[:, worst], inverse[worst]) / inverse[worst, worst]
        inverse = np.delete(np.delete(inverse, worst, 0), worst, 1)
    final = np.zeros(d)
    final[left] = inverse @ right[left]
    return [(name, int(r), float(c)) for name, r, c in zip(names, ranks, final, strict=True)]


def recursive_elimination(df: DataFrame, features: list[str], target: str, keep: int, key: str | None = None, alpha: float = 1.0) -> DataFrame:
    """feature, rank, coefficient (by key, a whole number, where given): recursive feature elimination with a ridge.

    The data are read once, into the moments of all features and the target; every elimination and refit is
    done on those, in a task for each key that holds as many rows as there are pairs of features. Rows with a missing
    value are left out. Of equal coefficients the feature named first goes first.
    """
    by = F.col(key).cast("long") if key else F.lit(0).cast("long")
    rows = df.select(by.alias("_key"), F.array(*[F.col(c).cast("double") for c in (*features, target)]).alias("values"))
    moments = pair_moments(rows.filter(~F.exists("values", lambda v: v.isNull())), "_key")

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group[0], *row) for row in eliminated(frame, features, keep, alpha)], columns=["_key", "feature", "rank", "coefficient"])

    out = moments.groupBy("_key").applyInPandas(run, "_key long, feature string, rank int, coefficient double")
    return out.withColumnRenamed("_key", key) if key else out.drop("_key")


def fold_errors(moments: pd.DataFrame, d: int, alphas: list[float]) -> pd.DataFrame:
    """fold, alpha, n, mse, r2 of ridge regressions on the other folds, from the folds' moments alone.

    Features are standardised on the training folds (population std). What a model leaves of a held-out fold is a
    quadratic form of the fold's moments, so no row is predicted. A fold without the others has no model.
    """
    folds = sorted(moments["fold"].unique().tolist())
    g = {f: np.zeros((d + 2, d + 2)) for f in folds}  # features, target, constant
    for f, part in moments.groupby("fold"):
        i, j, m = part["i"].to_numpy(), part["j"].to_numpy(), g[f]
        m[i, j] = m[j, i] = part["sij"].to_numpy()
        own = part[part["i"] == part["j"]]
        m[own["i"], d + 1] = m[d + 1, own["i"]] = own["si"].to_numpy()
        m[d + 1, d + 1] = own["n"].iloc[0]
    whole, out = sum(g.values()), []
    for f in folds:
        train, n = whole - g[f], (whole - g[f])[d + 1, d + 1]
        if n < 2:
            continue
        mean = train[: d + 1, d + 1] / n
        cov = train[: d + 1, : d + 1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
        scale = np.where(sd > 1e-12, sd, np.inf)
        test, m = g[f], g[f][d + 1, d + 1]
        spread = test[d, d] - test[d, d + 1] ** 2 / m
        for alpha in alphas:
            w = np.linalg.solve(n * cov[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d), n * cov[:d, d] / scale) / scale
            left = np.concatenate([-w, [1.0, -(mean[d] - w @ mean[:d])]])
            sse = max(float(left @ test @ left), 0.0)
            out.append((f, float(alpha), int(m), sse / m, 1 - sse / spread if spread > 1e-12 else 0.0))
    return pd.DataFrame(out, columns=["fold", "alpha", "n", "mse", "r2"])


def ridge_grid(df: DataFrame, features: list[str], target: str, fold: str, alphas: list[float]) -> DataFrame:
    """fold, alpha, n, mse, r2: a cross-validated grid of ridge regressions from one pass over the data.

    The moments of the folds (whole numbers) are added up once; all fits and errors follow from them, in one
    task that holds as many rows as there are folds times pairs of features. Rows with a missing value are left out.
    """
    rows = df.select(F.col(fold).cast("long").alias("fold"), F.array(*[F.col(c).cast("double") for c in (*features, target)]).alias("values"))
    moments = pair_moments(rows.filter(F.col("fold").isNotNull() & ~F.exists("values", lambda v: v.isNull())), "fold")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fold_errors(frame, len(features), alphas)

    return moments.groupBy().applyInPandas(run, "fold long, alpha double, n long, mse double, r2 double")


@dataclass
class Discriminants:
    """Linear discriminants: for each class a row of coefficients and an intercept."""

    classes: list[int]
    coefficients: list[list[float]]
    intercepts: list[float]


def discriminants(df: DataFrame, features: list[str], label: str) -> Discriminants:
    """Linear discriminant analysis with pooled covariance and the classes' shares as priors.

    One aggregate by class gives all moments; the driver gets as many numbers as there are pairs of features, and
    features for each class. The label is a whole number. Rows with a missing value are left out.
    """
    rows = df.select(F.col(label).cast("long").alias("_label"), F.array(*[F.col(c).cast("double") for c in features]).alias("values"))
    moments = pair_moments(rows.filter(F.col("_label").isNotNull() & ~F.exists("values", lambda v: v.isNull())), "_label").persist()
    within = moments.groupBy("i", "j").agg(F.sum(F.col("sij") - F.col("si") * F.col("sj") / F.col("n")).alias("w")).collect()
    means = moments.filter("i = j").select("_label", "i", "n", (F.col("si") / F.col("n")).alias("m")).collect()
    moments.unpersist()
    d = len(features)
    classes = sorted({r["_label"] for r in means})
    at = {c: k for k, c in enumerate(classes)}
    mu, counts, scatter = np.zeros((len(classes), d)), np.zeros(len(classes)), np.zeros((d, d))
    for r in means:
        mu[at[r["_label"]], r["i"]], counts[at[r["_label"]]] = r["m"], r["n"]
    for r in within:
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = r["w"]
    inverse = np.linalg.pinv(scatter / (counts.sum() - len(classes)))
    coefficients = mu @ inverse
    intercepts = np.log(counts / counts.sum()) - (coefficients * mu).sum(1) / 2
    return Discriminants(classes, coefficients.tolist(), intercepts.tolist())


def discriminant_scores(df: DataFrame, model: Discriminants, features: list[str]) -> DataFrame:
    """df with predicted (the class of the greatest score; of equal ones the least class) and scores, by class."""
    scores = []
    for row, start in zip(model.coefficients, model.intercepts, strict=True):
        total = F.lit(start)
        for c, weight in zip(features, row, strict=True):
            total = total + F.lit(weight) * F.col(c)
        scores.append(total)
    out = df.withColumn("scores", F.array(*scores))
    where = F.array_position("scores", F.array_max("scores"))
    return out.withColumn("predicted", F.get(F.array(*[F.lit(c) for c in model.classes]), (where - 1).cast("int")))
