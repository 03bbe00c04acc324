"""Dependencies and histories: cycles, self-loops, missing outputs, deep chains."""

import random

import pytest

from neurospan import scratch
from neurospan.operators import lineage as ln


def pairs(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def reachable(edges):
    """Fewest steps between all nodes by breadth-first search from each."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in after:
        level, at = {start}, 0
        while level:
            at += 1
            level = {b for a in level for b in after.get(a, ())} - {t for s, t in out if s == start}
            out |= {(start, b): at for b in level}
    return out


def test_closure_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(None, 1), (1, None), (2, 2), (2, 2)]
    got = pairs(ln.closure(spark.createDataFrame(edges, "source long, target long")))
    want = reachable([e for e in edges if None not in e])
    assert got == want


def test_self_loop_and_three_cycle(spark):
    edges = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "b"), ("f", "g")], "source string, target string")
    found = ln.closure(edges)
    assert {r["node"] for r in ln.cyclic(found).collect()} == {"a", "b", "c", "d"}
    assert pairs(found)["b", "b"] == 3 and pairs(found)["e", "d"] == 3
    assert ln.closure(edges.limit(0)).count() == 0


def test_lineage_of_a_deep_chain_and_of_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(1000)]
    rows += [(2000, 2000), (3000, 3002), (3001, 3000), (3002, 3001), (3003, 3002), (4000, 99999), (4001, 4000)]
    out = {r["version"]: (r["root"], r["depth"], r["cyclic"]) for r in ln.lineage(spark.createDataFrame(rows, "version long, parent long")).collect()}
    assert all(out[i] == (0, i, False) for i in range(1000))
    assert all(out[i] == (None, None, True) for i in (2000, 3000, 3001, 3002, 3003))
    assert out[4000] == (4000, 0, False) and out[4001] == (4000, 1, False)


def test_ancestors(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(i) if i % 9 else None) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (103, 100), (104, 104)]
    parent = dict(rows)
    want = {}
    for v in parent:
        at, n, seen = parent[v], 1, set()
        while at is not None and at not in seen:
            want[v, at] = n
            seen.add(at)
            at, n = parent.get(at), n + 1
    assert pairs(ln.ancestors(spark.createDataFrame(rows, "version long, parent long"))) == want


CONFIG = "stage string, name string, depends_on map<string,string>, subject string, session string, task string, run string"


def test_resolution_says_what_is_wrong(spark):
    rows = [
        ("epochs", "v1", {"task": "rest", "preprocessing": "standard"}, "sub-1", "01", "rest", "02"),
        ("epochs", "v2", {"preprocessing": "strict"}, "sub-1", "01", "rest", "02"),
        ("source", "v1", {"epochs": "v1"}, "sub-1", "01", "rest", None),
        ("features", "v1", {"preprocessing": "standard", "source": "dspm", "features": "conn"}, "sub-1", None, "rest", "02"),
        ("epochs", "odd", {"weather": "fine"}, "sub-1", "01", "rest", "02"),
        ("epochs", "same", {"epochs": "same"}, "sub-1", "01", "rest", "02"),
        ("epochs", "none", {}, "sub-1", "01", "rest", "02"),
    ]
    outputs = spark.createDataFrame([("preprocessing/standard/sub-1/ses-01/task-rest/run-02",), ("features/standard/rest/variant-dspm/conn",), ("features/standard/rest/variant-dspm/conn",)], "path string")
    out = {(r["name"], r["dependency"]): (r["path"], r["found"], r["problem"], r["needs"]) for r in ln.resolve(spark.createDataFrame(rows, CONFIG), outputs).filter("stage <> 'features'").collect()}
    assert out == {
        ("v1", "task"): (None, True, None, []),
        ("v1", "preprocessing"): ("preprocessing/standard/sub-1/ses-01/task-rest/run-02", True, None, []),
        ("v2", "preprocessing"): ("preprocessing/strict/sub-1/ses-01/task-rest/run-02", False, "missing", []),
        ("v1", "epochs"): (None, False, "incomplete", ["preprocessing"]),
        ("odd", "weather"): (None, False, "unknown", []),
        ("same", "epochs"): (None, False, "itself", ["preprocessing"]),
    }
    features = {r["dependency"]: (r["path"], r["problem"]) for r in ln.resolve(spark.createDataFrame(rows, CONFIG), outputs).filter("stage = 'features'").collect()}
    assert features == {"features": ("features/standard/rest/variant-dspm/conn", None), "preprocessing": (None, "incomplete"), "source": (None, "incomplete")}


class Cluster:
    """A session on a cluster, as far as work_dir looks at it."""

    def __init__(self, warehouse, checkpoint=None):
        self.conf = self
        self.sparkContext = self
        self.applicationId, self.master, self.warehouse, self.checkpoint = f"app{id(self)}", "spark://host:7077", warehouse, checkpoint

    def getConf(self):
        return {"spark.checkpoint.dir": self.checkpoint}

    def get(self, key, default=None):
        return self.warehouse if key == "spark.sql.warehouse.dir" else default


def test_no_local_folder_on_a_cluster():
    for place in ("/home/x/warehouse", "file:/home/x/warehouse", "file:///home/x/warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.work_dir(Cluster(place))
    assert scratch.work_dir(Cluster("hdfs://n/warehouse")).startswith("hdfs://n/warehouse/neurospan-")
    assert scratch.work_dir(Cluster("/w", "s3a://b/c/")).startswith("s3a://b/c/neurospan-")


def test_long_histories_write_a_fixed_number_of_rows_for_each_version(spark, monkeypatch):
    monkeypatch.setattr(ln, "DOUBLED", 300)
    rows = [(i, i - 1 if i else None) for i in range(4000)] + [(5000 + i, 5000 + (i + 1) % 500) for i in range(500)] + [(6000 + i, 5000 + i % 7) for i in range(50)]
    rows += [(7000, 7000), (7001, 7000), (8000, 99999), (8001, 8000), (8002, 8000)]
    sizes = []

    def counted(df, name):
        out = scratch.written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ln, "written", counted)
    found = ln.lineage(spark.createDataFrame(rows, "version long, parent long")).collect()
    out = {r["version"]: (r["root"], r["depth"], r["cyclic"]) for r in found}
    assert len(found) == len(out) == len(rows)
    assert all(out[i] == (0, i, False) for i in range(4000))
    assert all(out[v] == (None, None, True) for v, _ in rows if 5000 <= v < 8000)
    assert (out[8000], out[8001], out[8002]) == ((8000, 0, False), (8000, 1, False), (8000, 1, False))
    assert sum(sizes) < 7 * len(rows)


def test_closure_looks_for_earlier_pairs_once_in_several_levels(spark, monkeypatch):
    plans = []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.written(df, name)

    monkeypatch.setattr(ln, "written", planned)
    edges = [(i, i + 1) for i in range(12)] + [(5, 4), (0, 3), (9, 9)]
    assert pairs(ln.closure(spark.createDataFrame(edges, "source long, target long"))) == reachable(edges)
    assert 1 <= sum("LeftAnti" in p for p in plans) <= 5
