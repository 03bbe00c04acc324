"""Graphs, cluster tests, elimination, discriminants, validation and column scans against plain versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.operators import clusters as cl
from neurospan.operators import graphs as gr
from neurospan.operators import learning as le
from neurospan.operators import validation as va
from neurospan.scratch import written
from neurospan.sources import scan as sc


def floyd(n, links):
    d = [[0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for i, j, w in links:
        if i != j:
            d[i][j] = d[j][i] = min(d[i][j], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return {(i, j): d[i][j] for i in range(n) for j in range(n) if i != j and d[i][j] < math.inf}


@pytest.mark.parametrize("weighted", [False, True])
def test_shortest_paths_of_several_graphs(spark, weighted):
    rng = random.Random(1)
    graphs = {g: [(*rng.sample(range(9), 2), rng.randint(0, 20) / 4) for _ in range(n)] for g, n in (("a", 7), ("b", 16), ("c", 3))}
    graphs["line"] = [(i, i + 1, 0.5) for i in range(8)] + [(0, 8, 5.0)]
    rows = [(g, i, j, w) for g, links in graphs.items() for i, j, w in links] + [("a", 3, 3, 1.0), ("a", None, 1, 1.0), ("b", *graphs["b"][0])]
    df = spark.createDataFrame(rows, "rec string, roi_i int, roi_j int, w double")
    got = {}
    for r in gr.shortest_paths(df, "rec", "w" if weighted else None).collect():
        got.setdefault(r["rec"], {})[r["source"], r["target"]] = r["distance"]
    assert got == {g: floyd(9, [(i, j, w if weighted else 1) for i, j, w in links]) for g, links in graphs.items()}


def test_mean_paths_need_all_pairs(spark):
    links = spark.createDataFrame([("whole", 0, 1), ("whole", 1, 2), ("split", 0, 1)], "rec string, roi_i int, roi_j int")
    nodes = spark.createDataFrame([(g, i) for g in ("whole", "split", "bare") for i in range(3)] + [("one", 0)], "rec string, node int")
    out = {r["rec"]: (r["n_nodes"], r["n_joined"], r["connected"], r["mean_distance"]) for r in gr.path_summary(gr.shortest_paths(links, "rec"), nodes, "rec").collect()}
    assert out == {"whole": (3, 6, True, 8 / 6), "split": (3, 2, False, None), "bare": (3, 0, False, None), "one": (1, 0, True, 0.0)}
    assert gr.shortest_paths(links.limit(0), "rec").count() == 0


def plain_clusters(t, threshold):
    out, k = [], 0
    while k < len(t):
        if t[k] is None or abs(t[k]) <= threshold:
            k += 1
            continue
        z = k
        while z < len(t) and t[z] is not None and abs(t[z]) > threshold and (t[z] > 0) == (t[k] > 0):
            z += 1
        out.append((t[k] > 0, k, z - 1, sum(map(abs, t[k:z]))))
        k = z
    return out


def t_values(x):
    out = []
    for column in x.T:
        v = column[~np.isnan(column)]
        sd = v.std(ddof=1) if len(v) > 1 else 0
        out.append(v.mean() / (sd / math.sqrt(len(v))) if sd > 1e-9 else None)
    return out


def test_cluster_test_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 30))
    x[:, 8:14] += 1.2
    x[3, 5] = np.nan
    x[:, 20] = 0.0
    rows = [(s, t, None if math.isnan(v) else float(v)) for s, row in enumerate(x) for t, v in enumerate(row)]
    df = spark.createDataFrame(rows, "subject long, time int, value double").repartition(3)
    n = 60
    flips = spark.range(n + 1).selectExpr("id AS p").crossJoin(spark.range(12)).select("p", "id", cl.sign(F.col("p"), F.col("id"), 5).alias("g")).collect()
    g = {(r["p"], r["id"]): r["g"] for r in flips}
    assert {g[0, s] for s in range(12)} == {1.0} and 0.3 < np.mean([v > 0 for (p, _), v in g.items() if p]) < 0.7
    most = [max((m for *_, m in plain_clusters(t_values(x * np.array([[g[p, s]] for s in range(12)])), 1.5)), default=0) for p in range(n + 1)]
    want = [(pos, a, z, m, sum(v >= m - 1e-9 for v in most) / (n + 1)) for pos, a, z, m in plain_clusters(t_values(x), 1.5)]
    got = sorted((r["positive"], r["start"], r["stop"], r["mass"], r["p"]) for r in cl.cluster_test(df, "subject", "time", "value", n, 1.5, 5).collect())
    assert len(got) == len(want) > 1
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 and a[4] == b[4]
    assert min(r[4] for r in got if r[1] <= 10 <= r[2]) <= 2 / (n + 1)


def refit(x, y, keep, alpha):
    """Backward elimination with a fit on the data in each round."""
    z = (x - x.mean(0)) / x.std(0)
    left, ranks = list(range(x.shape[1])), [1] * x.shape[1]
    for rank in range(x.shape[1], keep, -1):
        w = z[:, left]
        c = np.linalg.solve(w.T @ w + alpha * np.eye(len(left)), w.T @ (y - y.mean()))
        ranks[left.pop(int(np.argmin(np.abs(c))))] = rank - keep + 1
    w = z[:, left]
    c = dict(zip(left, np.linalg.solve(w.T @ w + alpha * np.eye(len(left)), w.T @ (y - y.mean())), strict=True))
    return [(ranks[i], c.get(i, 0.0)) for i in range(x.shape[1])]


def test_elimination_from_moments_is_that_from_data(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for key in (1, 2):
        x = rng.normal(size=(150, 8))
        x[:, 5] = x[:, 0] + 0.3 * x[:, 5]
        y = x @ np.array([3, 0, -2, 0.1, 0, 1, 0, 0.5]) + rng.normal(size=150)
        want[key] = refit(x, y, 3, 1.0)
        rows += [(key, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    names = [f"f{i}" for i in range(8)]
    rows.append((1, *[None] * 8, 1.0))
    df = spark.createDataFrame(rows, f"key int, {', '.join(f'{n} double' for n in names)}, y double").repartition(4)
    out = le.recursive_elimination(df, names, "y", 3, "key").collect()
    for key in want:
        got = {r["feature"]: (r["rank"], r["coefficient"]) for r in out if r["key"] == key}
        for i, (rank, c) in enumerate(want[key]):
            assert got[names[i]][0] == rank and abs(got[names[i]][1] - c) < 1e-8
        assert sorted(r for r, _ in got.values()) == [1, 1, 1, 2, 3, 4, 5, 6]
    constant = le.recursive_elimination(df.filter("key = 1").withColumn("f1", F.lit(2.0)), names, "y", 7).filter("rank = 2").first()
    assert constant["feature"] == "f1" and constant["coefficient"] == 0


def test_grid_errors_are_those_of_predictions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = x @ [1.0, -0.5, 4.0, 0.0] + rng.normal(size=120)
    fold = rng.integers(0, 3, 120)
    df = spark.createDataFrame([(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y, strict=True)] + [(0, None, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], "fold int, a double, b double, c double, d double, y double").repartition(3)
    got = {(r["fold"], r["alpha"]): (r["n"], r["mse"], r["r2"]) for r in le.ridge_grid(df, ["a", "b", "c", "d"], "y", "fold", [0.1, 10.0]).collect()}
    assert len(got) == 6
    for (f, alpha), (n, mse, r2) in got.items():
        xt, yt, xv, yv = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
        z = (xt - xt.mean(0)) / xt.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (yt - yt.mean()))
        left = yv - yt.mean() - (xv - xt.mean(0)) / xt.std(0) @ w
        assert n == len(yv) and abs(mse - (left**2).mean()) < 1e-8 and abs(r2 - (1 - (left**2).sum() / ((yv - yv.mean()) ** 2).sum())) < 1e-8


def test_discriminants(spark):
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0, 0], [2, 1, 0], [0, 3, 1]])
    label = rng.choice([3, 7, 11], p=[0.5, 0.3, 0.2], size=400)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 0.8]]) + centres[(label - 3) // 4]
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(label, x, strict=True)] + [(None, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0)], "label int, a double, b double, c double").repartition(3)
    model = le.discriminants(df, ["a", "b", "c"], "label")
    mu = np.array([x[label == k].mean(0) for k in (3, 7, 11)])
    within = sum((x[label == k] - mu[i]).T @ (x[label == k] - mu[i]) for i, k in enumerate((3, 7, 11))) / (400 - 3)
    inverse = np.linalg.inv(within)
    prior = np.log([np.mean(label == k) for k in (3, 7, 11)])
    scores = x @ inverse @ mu.T - 0.5 * np.einsum("ki,ij,kj->k", mu, inverse, mu) + prior
    out = le.discriminant_scores(df.filter("label is not null and a is not null"), model, ["a", "b", "c"])
    got = {(r["a"], r["b"]): (r["predicted"], r["scores"]) for r in out.collect()}
    for row, s in zip(x, scores, strict=True):
        predicted, mine = got[row[0], row[1]]
        assert predicted == (3, 7, 11)[int(s.argmax())] and np.allclose(mine, s)
    assert np.mean([got[r[0], r[1]][0] == k for r, k in zip(x, label, strict=True)]) > 0.8


GOOD = {"preprocessing": {"l_freq": 1, "h_freq": 40, "ica_method": "picard"}, "epochs": {"tmin": -0.2, "tmax": 0.8, "baseline": [-0.2, 0]}, "source": {"method": "dSPM"}, "connectivity": {"methods": ["plv", "wpli"]}, "prediction": {"prediction_type": "between_group", "cv_strategy": "kfold"}}


def changed(**places):
    out = json.loads(json.dumps(GOOD))
    for place, value in places.items():
        section, key = place.split("__")
        out[section][key] = value
    return out


def test_every_rule_of_a_configuration(spark):
    cases = {
        "good": (GOOD, []), "empty": ({}, []),
        "order": (changed(preprocessing__l_freq=40), ["frequency_order"]), "one": (changed(preprocessing__l_freq=None), []),
        "ica": (changed(preprocessing__ica_method="jade"), ["ica_method"]), "epochs": (changed(epochs__tmax=-0.2), ["epoch_order", "baseline_window"]),
        "baseline": (changed(epochs__baseline=[-0.3, 0]), ["baseline_window"]), "no baseline": (changed(epochs__baseline=None), []),
        "source": (changed(source__method="beam"), ["source_method"]), "methods": (changed(connectivity__methods=["plv", "dwpli", "aec"]), ["connectivity_method"] * 2),
        "kind": (changed(prediction__prediction_type="x"), ["prediction_type"]), "cv": (changed(prediction__cv_strategy="loo"), ["cv_strategy"]),
    }
    rows = [(k, json.dumps(d)) for k, (d, _) in cases.items()] + [("broken", "{"), ("null", None)]
    docs = spark.createDataFrame(rows, "id string, document string")
    issues = va.config_issues(docs)
    got = {}
    for r in issues.collect():
        got.setdefault(r["id"], []).append(r["rule"])
    assert got == {**{k: rules for k, (_, rules) in cases.items() if rules}, "broken": ["document"], "null": ["document"]}
    warns = {r["rule"] for r in issues.filter("severity = 'warning'").collect()}
    assert warns == {"baseline_window", "connectivity_method"}
    verdicts = {r["id"]: (r["valid"], r["n_errors"], r["n_warnings"]) for r in va.verdicts(docs, issues).collect()}
    assert verdicts["good"] == (True, 0, 0) and verdicts["epochs"] == (False, 1, 1) and verdicts["methods"] == (True, 0, 2) and len(verdicts) == len(rows)


def test_every_rule_of_a_project(spark):
    run = lambda file: [{"id": "1", "runs": [{"id": "1", "file": file}]}]
    docs = [("p", {"root": "/p", "subjects": [{"id": "a", "sessions": run("/p/a.edf")}, {"id": "b", "sessions": run("/p/b.edf")}, {"id": "c", "sessions": []}, {"id": "d"}]}), ("q", {"root": "/q", "subjects": [{"id": "a", "sessions": []}]}), ("r", {"root": "/p", "subjects": []}), ("s", {"root": "/p"})]
    projects = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "id string, document string")
    places = spark.createDataFrame([("/p",), ("/p",), ("/p/a.edf",)], "path string")
    got = sorted((r["id"], r["rule"], r["severity"], r["place"]) for r in va.project_issues(projects, places).collect())
    assert got == [("p", "no_file", "error", "b/1/1"), ("p", "no_sessions", "warning", "c"), ("p", "no_sessions", "warning", "d"), ("q", "no_root", "error", "root"), ("r", "no_subjects", "warning", "subjects"), ("s", "no_subjects", "warning", "subjects")]


@pytest.mark.parametrize("held", [1, 200_000])
def test_distinct_values_up_to_a_bound(spark, monkeypatch, held):
    monkeypatch.setattr(sc, "HELD", held)
    rows = [(i % 3, i % 19, i % 20, f"t{i}", None, float(i % 2)) for i in range(600)] + [(None, 1, 1, "x", "y", None)]
    df = spark.createDataFrame(rows, "file int, a int, b int, c string, d string, e double").repartition(5)
    got = {(r["file"], r["column"]): (r["n_distinct"], r["values"]) for r in sc.distinct_values(df, "file", ["a", "b", "c", "d", "e"]).collect()}
    for f in ("0", "1", "2"):
        assert got[f, "a"] == (19, sorted(map(str, range(19)))) and got[f, "b"] == (None, None) == got[f, "c"] and got[f, "d"] == (0, []) and got[f, "e"] == (2, ["0.0", "1.0"])
    assert got[None, "c"] == (1, ["x"]) and got[None, "e"] == (0, [])
    out = {r["column"]: (r["categorical"], r["files"], r["few"]) for r in sc.categorical_columns(df.dropna(subset=["file"]), "file", ["a", "b", "c", "d", "e"]).collect()}
    assert out == {"a": (True, 3, 3), "b": (False, 3, 0), "c": (True, 3, 0), "d": (True, 0, 3), "e": (True, 3, 3)}


def test_event_names_come_from_the_first_naming_column(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "stimulus string, condition string")
    assert sorted(map(tuple, sc.event_names(df).collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, sc.event_names(df, "condition").collect())) == [("x", 2), ("y", 1)]
    assert sc.event_names(df, "other").count() == 0


def test_behaviour_meets_its_recording(spark):
    from neurospan.operators import records as rc

    recorded = spark.createDataFrame([("r1", "s", "p", "task_Block1"), ("r2", "s", "p", "task_Block3"), ("r3", "s", "q", "any"), ("r4", "t", "p", "task_Block1")], "recording string, subject string, paradigm string, variant string")
    behaviour = spark.createDataFrame([("s", "p", "block1", "/b"), ("s", "p", "BLOCK1", "/a"), ("s", "q", None, "/c"), ("s", "p", "Block2", "/d")], "subject string, paradigm string, block string, path string")
    triggers = spark.createDataFrame([("r1", 4.0, 7), ("r1", 2.5, 7), ("r1", 1.0, 9), ("r2", 3.0, 8), ("x", 0.0, 7)], "recording string, time double, code int")
    starts = spark.createDataFrame([("p", 7), ("p", 7), ("q", 8)], "paradigm string, code int")
    out = {r["recording"]: (r["file"], r["offset"]) for r in rc.match_behaviour(recorded, behaviour, triggers, starts).collect()}
    assert out == {"r1": ("/a", 2.5), "r2": (None, 0.0), "r3": ("/c", 0.0), "r4": (None, 0.0)}


@pytest.mark.parametrize("weighted", [False, True])
def test_paths_send_no_table_to_the_driver(spark, monkeypatch, weighted):
    plans = []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(gr, "written", planned)
    links = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 2, 0.5), (1, 2, 3, 0.5)], "rec long, roi_i int, roi_j int, w double")
    assert gr.shortest_paths(links, "rec", "w" if weighted else None).count() == 12
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
