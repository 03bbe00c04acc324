"""Connected components by hooking and pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import sent_if_small, stored

#: Bytes of a vertex with its labels in a table that is sent to every task.
VERTEX = 32


def components(edges: DataFrame) -> DataFrame:
    """v, label from edges (a, b): the smallest vertex that each vertex reaches.

    Every round gives a vertex the least label among its neighbours and itself, then the label of
    its label; both keep labels inside the component, and the rounds end when none changes. A
    vertex with many edges meets partial minima, and only counts reach the driver.
    """
    edges = edges.filter("a <> b").select("a", "b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "cc-labels")
    n = labels.count()
    while n:
        met = both.join(sent_if_small(labels.select(F.col("v").alias("b"), "label"), VERTEX, n), "b").select(F.col("a").alias("v"), F.lit(None).cast("long").alias("old"), "label")
        own = labels.select("v", F.col("label").alias("old"), "label")
        hooked = stored(own.unionByName(met).groupBy("v").agg(F.max("old").alias("old"), F.min("label").alias("label")), "cc-hooked")
        # what a vertex has learnt also holds for the vertex it was labelled with, and a label's label for all that have it
        told = hooked.groupBy(F.col("old").alias("v")).agg(F.min("label").alias("told"))
        jump = hooked.select(F.col("v").alias("label"), F.col("label").alias("far"))
        moved = hooked.join(sent_if_small(told, VERTEX, n), "v", "left").join(sent_if_small(jump, VERTEX, n), "label", "left")
        moved = stored(moved.select("v", "old", F.least("label", F.coalesce("told", "label"), F.coalesce("far", "label")).alias("label")), "cc-labels")
        labels = moved.select("v", "label")
        if moved.filter("old <> label").isEmpty():
            break
    return labels
