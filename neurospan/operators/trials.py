"""Trial filters and binning: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_by_rt(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Inclusive bounds; a missing value fails any bound given and stays where none is."""
    if lo is not None:
        df = df.filter(F.col(column) >= lo)
    return df if hi is None else df.filter(F.col(column) <= hi)


def filter_by_accuracy(df: DataFrame, column: str, keep: str) -> DataFrame:
    wanted = {"correct": 1, "incorrect": 0}
    if keep not in wanted:
        raise ValueError(f"keep must be one of {sorted(wanted)}")
    return df.filter(F.col(column) == wanted[keep])


def drop_missing_responses(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0) if column in df.columns else df


def drop_sequential(df: DataFrame, first: int, last: int, keys: list[str], order: str) -> DataFrame:
    """Drops the first and last positions of each group; a group that would become empty goes."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    ranked = ranked.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return ranked.filter((F.col("_rn") > first) & (F.col("_rn") <= F.col("_n") - last)).drop("_rn", "_n")


def quantile_edges(df: DataFrame, column: str, q: int, keys: list[str] = ()) -> DataFrame:
    """Exact linearly interpolated inner and outer edges, duplicates dropped."""
    probs = F.array(*[F.lit(i / q) for i in range(q + 1)])
    edges = F.array_distinct(F.percentile(column, probs)).alias("edges")
    return df.groupBy(*keys).agg(edges)


def bin_by_edges(value: Column, edges: Column) -> Column:
    """Right-closed bins with the lowest edge included: how many inner edges lie below the value."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value)).cast("long")


def bin_quantiles(df: DataFrame, column: str, q: int, keys: list[str] = ()) -> DataFrame:
    """Adds bin; edges are one row for each key, so the join side is small by construction."""
    edges = quantile_edges(df, column, q, list(keys))
    joined = df.join(edges, list(keys)) if keys else df.join(F.broadcast(edges))
    return joined.withColumn("bin", bin_by_edges(F.col(column), F.col("edges"))).drop("edges")


def bin_within(df: DataFrame, column: str, q: int, by: str) -> DataFrame:
    """Quantile bins inside each condition; only missing values fall out."""
    return bin_quantiles(df.filter(F.col(column).isNotNull()), column, q, [by])


def bin_positions(df: DataFrame, k: int, keys: list[str], order: str) -> DataFrame:
    """k blocks of n // k positions, the remainder in the last one; groups under k rows are dropped."""
    n = F.count("*").over(W.partitionBy(*keys))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    ranked = df.withColumn("_n", n).withColumn("_rn", rank).filter(F.col("_n") >= k)
    block = F.least(F.floor((F.col("_rn") - 1) / F.floor(F.col("_n") / k)), F.lit(k - 1))
    return ranked.withColumn("bin", block.cast("long")).drop("_n", "_rn")


def bin_equal_width(df: DataFrame, column: str, k: int) -> DataFrame:
    """k right-closed bins of equal width; the lowest edge is widened, so the minimum is inside."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.filter(F.col(column).isNotNull()).join(F.broadcast(span))
    width = (F.col("_hi") - F.col("_lo")) / k
    place = F.ceil((F.col(column) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) - 1
    return joined.withColumn("bin", F.greatest(F.least(F.coalesce(place, F.lit(0)), F.lit(k - 1)), F.lit(0)).cast("long")).drop("_lo", "_hi")


def bin_custom(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Right-closed bins between sorted edges; the lowest edge itself lies outside, as do values beyond."""
    value = F.col(column)
    inside = df.filter((value > edges[0]) & (value <= edges[-1]))
    return inside.withColumn("bin", sum(((value > e).cast("long") for e in edges[1:-1]), F.lit(0).cast("long")))


def label_accuracy(df: DataFrame, stimulus: str, accuracy: str, response: str) -> DataFrame:
    """A row for each bin that a trial belongs to: correct, incorrect, and missing (no response time).

    Bins may overlap: a trial without response time still has its accuracy bin.
    """
    labels = F.array_compact(F.array(
        F.when(F.col(accuracy) == 1, F.lit("correct")),
        F.when(F.col(accuracy) == 0, F.lit("incorrect")),
        F.when(F.col(response).isNull() | (F.col(response) == 0), F.lit("missing")),
    ))
    return df.withColumn("response", F.explode(labels)).withColumn("bin_name", F.concat_ws("_", stimulus, "response"))


def label_field(df: DataFrame, field: str) -> DataFrame:
    """Bins named by a field's value; rows without one fall out."""
    value = F.col(field).cast("string")
    return df.filter(value.isNotNull()).withColumn("bin_name", F.concat_ws("_", F.lit(field), value))


def match_responses(stimuli: DataFrame, responses: DataFrame, keys: list[str], limit: float, tail: float) -> DataFrame:
    """First response in (onset, min(onset + limit, next onset)] of each stimulus; others keep nulls.

    stimuli: keys, stim_id, onset; responses: keys, resp_id, t. The last stimulus' window ends at
    onset + min(limit, tail). Times are cut into slots of limit seconds; a window touches two slots
    at most, so each response is looked up in its own slot by an equi-join and the range is checked
    on what that returns.
    """
    nxt = F.coalesce(F.lead("onset").over(W.partitionBy(*keys).orderBy("onset", "stim_id")), F.col("onset") + tail)
    windows = stimuli.withColumn("_end", F.least(F.col("onset") + limit, nxt))
    slot = lambda c: F.floor(c / limit)
    slots = windows.withColumn("_slot", F.explode(F.sequence(slot(F.col("onset")), slot(F.col("_end")))))
    hits = slots.join(responses.withColumn("_slot", slot(F.col("t"))), [*keys, "_slot"])
    hits = hits.filter((F.col("t") > F.col("onset")) & (F.col("t") <= F.col("_end")))
    first = hits.groupBy(*keys, "stim_id").agg(F.min(F.struct("resp_id", "t")).alias("_hit"))
    joined = stimuli.join(first, [*keys, "stim_id"], "left")
    return joined.withColumn("resp_id", F.col("_hit.resp_id")).withColumn("t", F.col("_hit.t")).drop("_hit")


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """i-th row of left with the i-th of right inside each key; left rows stay."""
    rank = lambda cols: F.row_number().over(W.partitionBy(*keys).orderBy(*cols))
    return left.withColumn("_i", rank(left_order)).join(right.withColumn("_i", rank(right_order)), [*keys, "_i"], "left").drop("_i")


def first_appearance_codes(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """label, code: ranks of labels by first appearance, from 1; one row for each label."""
    first = df.groupBy(label).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("code", F.row_number().over(W.orderBy("_first", label)).cast("long")).drop("_first")


def match_conditions(events: DataFrame, conditions: DataFrame, name: str, code: str) -> DataFrame:
    """Events with every condition they belong to: by name first, else by one of its codes.

    conditions: condition, codes (array). The table is a task's configuration, a few rows.
    """
    codes = conditions.select("condition", F.explode("codes").alias("_code"))
    by_name = events.join(conditions.select("condition"), F.col(name) == F.col("condition"))
    unnamed = events.join(conditions.select(F.col("condition").alias(name)), name, "left_anti")
    by_code = unnamed.join(codes, F.col(code) == F.col("_code")).drop("_code")
    return by_name.unionByName(by_code)


def apply_bins(df: DataFrame, configs: list[dict]) -> DataFrame:
    """df with bin_name, a row for each bin that a trial is in; a later configuration takes over names that an earlier one made.

    Types: accuracy (stimulus), rt_quantiles (bins), positions (bins), field (field), stimulus_x_rt
    (stimulus, bins); prefix names the numbered bins. Without configurations all trials are in all.
    """
    if not configs:
        return df.withColumn("bin_name", F.lit("all"))
    numbered = lambda rows, *prefix: rows.withColumn("bin_name", F.concat_ws("_", *prefix, F.concat(F.lit("q"), (F.col("bin") + 1).cast("string")))).drop("bin")
    made = []
    for i, c in enumerate(configs):
        kind, k, prefix = c["type"], c.get("bins", 4), F.lit(c.get("prefix", c["type"]))
        if kind == "accuracy":
            rows = label_accuracy(df, c["stimulus"], "accuracy", "response_time").drop("response")
        elif kind == "rt_quantiles":
            rows = numbered(bin_quantiles(df.filter("response_time > 0"), "response_time", k), prefix)
        elif kind == "positions":
            rows = numbered(bin_positions(df, k, ["subject_id"], "trial_idx"), prefix)
        elif kind == "field":
            rows = label_field(df, c["field"])
        elif kind == "stimulus_x_rt":
            rows = numbered(bin_within(df, "response_time", k, c["stimulus"]), F.col(c["stimulus"]))
        else:
            raise ValueError(f"unknown type of bins: {kind}")
        made.append(rows.select(*df.columns, "bin_name", F.lit(i).alias("_config")))
    both = made[0]
    for more in made[1:]:
        both = both.unionByName(more)
    last = both.groupBy("bin_name").agg(F.max("_config").alias("_config"))
    return both.join(last, ["bin_name", "_config"]).drop("_config")


def translated(codes: F.Column, names: F.Column) -> F.Column:
    """Codes (array of text) with those that are a name in the map names replaced by its code; order and repeats stay."""
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c))
