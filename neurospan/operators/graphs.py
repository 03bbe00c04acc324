"""Shortest paths in many small graphs at once: frontiers without lengths, relaxation with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.scratch import written


def _directed(links: DataFrame, key: str, length: str | None) -> DataFrame:
    size = F.lit(1) if length is None else F.col(length).cast("double")
    rows = links.select(F.col(key).alias("_key"), F.col("roi_i").alias("a"), F.col("roi_j").alias("b"), size.alias("size")).dropna()
    both = rows.unionByName(rows.select("_key", F.col("b").alias("a"), F.col("a").alias("b"), "size")).filter("a <> b")
    return written(both.groupBy("_key", "a", "b").agg(F.min("size").alias("size")), "links")


def shortest_paths(links: DataFrame, key: str, length: str | None = None) -> DataFrame:
    """key, source, target, distance of all nodes that a path joins, in the undirected graph of each key.

    links: key, roi_i, roi_j, and with length a column of lengths of 0 or more. Without lengths a round adds the
    pairs first reached by one more link; with them a round lowers what one more link makes shorter,
    until nothing changes. A round is one join of the last round's pairs with the links, for all
    graphs together; tables written are small files of many rows, so none is broadcast by the size of its files. Of repeated links the shortest counts; links of a node to itself, and with nulls, are none.
    """
    link = _directed(links, key, length)
    paths = fresh = link.select("_key", F.col("a").alias("source"), F.col("b").alias("target"), F.col("size").alias("distance"))
    while fresh.limit(1).count():
        onward = fresh.join(link.withColumnRenamed("a", "target").hint("merge"), ["_key", "target"]).filter("source <> b")
        onward = onward.groupBy("_key", "source", F.col("b").alias("target")).agg(F.min(F.col("distance") + F.col("size")).alias("distance"))
        if length is None:
            fresh = written(onward.join(paths.hint("merge"), ["_key", "source", "target"], "left_anti"), "paths")
            paths = paths.unionByName(fresh)
        else:
            before = paths.withColumnRenamed("distance", "_before")
            fresh = written(onward.join(before.hint("merge"), ["_key", "source", "target"], "left").filter("_before IS NULL OR distance < _before").drop("_before"), "paths")
            paths = written(paths.unionByName(fresh).groupBy("_key", "source", "target").agg(F.min("distance").alias("distance")), "paths")
    return paths.withColumnRenamed("_key", key)


def path_summary(paths: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, n_nodes, n_joined, connected, mean_distance: the mean over all pairs, null where some pair has no path.

    nodes: key and node, each once; a graph of one node is connected and has the mean 0.
    """
    n = nodes.groupBy(key).agg(F.count("*").alias("n_nodes"))
    total = paths.groupBy(key).agg(F.count("*").alias("n_joined"), F.sum("distance").alias("_sum"))
    out = n.join(total, key, "left").withColumn("n_joined", F.coalesce("n_joined", F.lit(0)))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    connected = F.col("n_joined") == pairs
    return out.select(key, "n_nodes", "n_joined", connected.alias("connected"), F.when(connected, F.coalesce(F.try_divide("_sum", pairs), F.lit(0.0))).alias("mean_distance"))
