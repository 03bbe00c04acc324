import pytest
from pyspark.sql import functions as F

from neurospan.functions.stats import argmax_first, exact_mean, safe_corr, sanitise
from neurospan.operators import behaviour as be
from neurospan.operators import trials as op
from neurospan.plans import behaviour_queries as bq


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_rt_bounds_are_inclusive_and_missing_fails(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in (None, nan, 0.0, 0.15, 2.0, 2.1)], "rt double").withColumn("rt", F.nullif("rt", F.lit(nan)))
    assert values(op.filter_by_rt(df, "rt", 0.15, 2.0), "rt") == [0.15, 2.0]
    assert op.filter_by_rt(df, "rt").count() == 6
    assert op.drop_missing_responses(df, "rt").count() == 3 and op.drop_missing_responses(df, "none").count() == 6
    with pytest.raises(ValueError):
        op.filter_by_accuracy(df, "rt", "sometimes")


def test_position_bins_give_the_remainder_to_the_last(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "s int, i int")
    sizes = {r["bin"]: r["count"] for r in op.bin_positions(df, 3, ["s"], "i").groupBy("bin").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 4}
    assert op.bin_positions(df.filter("i < 2"), 3, ["s"], "i").count() == 0


def test_quantile_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 2, 3, 4, 5)], "x double")
    assert values(op.bin_quantiles(df, "x", 4), "bin") == [0, 0, 0, 0, 1, 1, 2, 2]


def test_sequential_drop_counts_raw_rows(spark):
    df = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(2)], "s int, i int")
    assert values(op.drop_sequential(df, 2, 1, ["s"], "i"), "i") == [2, 3, 4]


def test_responses_match_the_first_inside_the_window(spark):
    stim = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0), (1, 3, 10.0)], "s int, stim_id int, onset double")
    resp = spark.createDataFrame([(1, 1, 1.5), (1, 2, 2.0), (1, 3, 3.0), (1, 4, 14.0)], "s int, resp_id int, t double")
    out = {r["stim_id"]: r["resp_id"] for r in op.match_responses(stim, resp, ["s"], 3.0, 5.0).collect()}
    assert out == {1: 1, 2: 3, 3: None}


def test_usability_and_is_ordered(spark):
    df = spark.createDataFrame([("a", "p", 1, None), ("a", "p", 2, True), ("b", "p", 1, True), ("b", "p", 2, None)], "s string, p string, k int, usable boolean")
    out = {r["s"]: r for r in be.usability_matrix(df, "s", "p", ["k"], ["p", "q"]).collect()}
    assert (out["a"]["p"], out["b"]["p"], out["a"]["q"]) == (False, True, None)
    assert (out["b"]["n_available"], out["b"]["n_usable"]) == (1, 1)


def test_quality_classes_differ_at_ten_percent(spark):
    df = spark.createDataFrame([(10.0, "none")], "bad double, sev string")
    r = df.select(be.quality_class(F.col("bad")).alias("a"), be.quality_class_b(F.col("bad"), F.col("sev")).alias("b")).first()
    assert (r["a"], r["b"]) == ("excellent", "good")


def test_summary_has_no_accuracy_without_responses(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, 0.5, True), (2, 1.5, False)], "s int, rt double, ok boolean")
    out = {r["s"]: r for r in be.usability(be.paradigm_summary(df, ["s"], F.col("rt").isNotNull(), F.col("ok"), F.col("rt"))).collect()}
    assert out[1]["accuracy"] is None and out[1]["reasons"] == ["high miss rate"]
    assert out[2]["accuracy"] == 0.5 and out[2]["std_rt"] == 0.5 and out[2]["usable"]


def test_constant_channels_have_no_correlation_and_ties_take_the_first(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.1), (1.0, 7.0, 0.2), (1.0, 7.0, 0.3)], "a double, b double, t double")
    r = df.agg(safe_corr("a", "b").alias("r"), argmax_first("t", "b", "t").alias("t")).first()
    assert r["r"] is None and r["t"] == 0.2
    name = spark.createDataFrame([(" a:b  c/?.txt ",)], "s string").select(sanitise(F.col("s")).alias("s")).first()["s"]
    assert name == "a_b_c_.txt"


def test_rates_right_at_a_limit_are_not_above_it(spark, tmp_path):
    columns = "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double"
    rows = [(1, "N", "F", 1.0, 0.05, 0.0)] * 3 + [(2, "N", "F", 1.0, 0.06, 0.0)] * 3 + [(3, "N", "F", 1.0, float("nan"), None)] * 3
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r["rec_id"]: r["score"] for r in bq.qc_score(spark, str(tmp_path)).collect()} == {1: 0.7, 2: 0.5, 3: 0.5}
    means = spark.createDataFrame([(0.1, None, 1e12)] * 3, "a double, b double, c double").agg(*[exact_mean(c) for c in "abc"]).first()
    assert tuple(means) == (0.1, None, 1e12)


def test_group_report_names_who_is_excluded(spark):
    df = spark.createDataFrame([("a", 10, False), ("a", 9, False), ("a", 1, True), ("b", 2, True)], "site string, rec long, ok boolean")
    assert {r["site"]: r["excluded"] for r in be.group_report(df, ["site"], "rec", "ok", []).collect()} == {"a": [9, 10], "b": []}
    assert "excluded" in bq.qc_aggregate(spark, "/root/testdata/sf0.001").columns
