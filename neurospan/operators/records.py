"""Operators on record tables: scores of subjects, component rules, importer tallies, and texts for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels by what their text contains, the first that fits; anything else is other.
COMPONENT_LABELS = (("eye", ("eye",)), ("muscle", ("muscle",)), ("heart", ("heart",)), ("line_noise", ("line", "noise")), ("channel_noise", ("channel", "noise")), ("brain", ("brain",)))


def component_label(text: Column) -> Column:
    low, out = F.lower(text), F.lit("other")
    for label, parts in reversed(COMPONENT_LABELS):
        fits = F.contains(low, F.lit(parts[0]))
        for p in parts[1:]:
            fits = fits & F.contains(low, F.lit(p))
        out = F.when(fits, label).otherwise(out)
    return out


def reject_components(df: DataFrame, labels: list[str], least: float = 0.8) -> DataFrame:
    """Components (label, prob) that go: the label is listed and its probability above least."""
    return df.withColumn("rejected", F.col("label").isin(labels) & (F.col("prob") > least))


def add_scores(subjects: DataFrame, phenotype: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A map of the columns' values that are numbers; subjects without a phenotype row have an empty map."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.expr(f"try_cast(`{c}` AS double)").alias("value")) for c in columns])
    scored = phenotype.select(key, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("scores"))
    return subjects.join(scored, key, "left").withColumn("scores", F.coalesce("scores", F.create_map().cast("map<string,double>")))


def relative_age(then: Column, now: Column) -> Column:
    """Age as people say it; unknown for a missing time."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    days, hours, minutes = F.floor(s / 86_400), F.floor(s / 3_600) % 24, F.floor(s / 60) % 60
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return (
        F.when(then.isNull(), "unknown").when(days == 1, "yesterday").when((days > 0) & (days < 7), F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days > 0, F.date_format(then, "yyyy-MM-dd")).when(hours > 0, ago(hours, "hour")).when(minutes > 0, ago(minutes, "minute")).otherwise("just now")
    )


def escape_html(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def import_tally(df: DataFrame, status: str) -> DataFrame:
    """Totals by outcome and the share of successes among what was tried."""
    n = lambda s: F.count_if(F.col(status) == s)
    return df.agg(
        F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.try_divide(100 * n("success"), F.count("*") - n("skipped")).alias("rate"),
    )


def inclusion(df: DataFrame, flag: str, show: str = "all", least: int | None = None, count: str = "n_epochs", text: str | None = None, column: str = "subject") -> DataFrame:
    """Rows to show: all, included or excluded; with least epochs; whose name holds the text in any case."""
    if show != "all":
        df = df.filter(F.col(flag) if show == "included" else ~F.col(flag))
    if least is not None:
        df = df.filter(F.col(count) >= least)
    return df if not text else df.filter(F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower())))


def expand_blocks(df: DataFrame, keys: list[str], arrays: dict[str, str], start: Column) -> DataFrame:
    """Trials from parallel arrays of a block: a row for each place, shorter arrays giving nulls, with the onset
    from the start and the durations before."""
    zipped = df.select(*keys, start.alias("_t0"), F.posexplode_outer(F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])).alias("trial", "_x"))
    rows = zipped.select(*keys, "_t0", "trial", *[F.col(f"_x.{n}").alias(n) for n in arrays])
    before = F.sum(F.coalesce("duration", F.lit(0.0))).over(W.partitionBy(*keys).orderBy("trial").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("onset", F.col("_t0") + F.coalesce(before, F.lit(0.0))).drop("_t0")


def well_sampled(epochs: DataFrame, least: int = 5) -> DataFrame:
    """Epoch rows of conditions with least epochs or more."""
    enough = epochs.groupBy("condition").agg(F.count_distinct("rec_id", "epoch_id").alias("_n")).filter(F.col("_n") >= least).select("condition")
    return epochs.join(enough, "condition", "left_semi")


def compare_variance(a: DataFrame, b: DataFrame) -> DataFrame:
    """channel with the variances of two pipelines; a channel that one lacks is null there."""
    var = lambda df, name: df.groupBy("channel").agg((F.var_pop("value") * 1e12).alias(name))
    return var(a, "first").join(var(b, "second"), "channel", "full")


def inclusion_summary(df: DataFrame, flag: str, count: str, *by: str) -> DataFrame:
    """total, included, percent, mean and sum of epochs, for each value of by; a missing count is 0, a missing mark excludes."""
    n = F.coalesce(F.col(count), F.lit(0))
    included = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return df.groupBy(*by).agg(F.count("*").alias("total"), included.alias("included"), (100 * included / F.count("*")).alias("percent"), F.avg(n).alias("mean_epochs"), F.sum(n).alias("sum_epochs"))


def epoch_batches(epochs: DataFrame, sessions: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_epochs, n_conditions, checked of every session: epochs 0 where none could be read, checked where a quality record is there.

    epochs: keys and condition, a row an epoch; sessions and checks: keys. Null keys meet null keys.
    """
    by = epochs.groupBy(*keys).agg(F.count("*").alias("n_epochs"), F.count_distinct("condition").alias("n_conditions"))
    known = checks.select(*keys).distinct().withColumn("_checked", F.lit(True))
    out = sessions.select(*keys).distinct()
    for side in (by, known):
        renamed = side.withColumnsRenamed({k: f"_{k}" for k in keys})
        out = out.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(*keys, zero("n_epochs"), zero("n_conditions"), F.coalesce("_checked", F.lit(False)).alias("checked"))


def match_behaviour(recorded: DataFrame, behaviour: DataFrame, triggers: DataFrame, starts: DataFrame) -> DataFrame:
    """recorded with file and offset: the first behavioural file of its subject and paradigm whose block its variant names, and when it starts.

    recorded: recording, subject, paradigm, variant; behaviour: subject, paradigm, block (null fits any variant, as does an empty one), path, the first by path
    counts; triggers: recording, time, code; starts: paradigm, code. offset is the time of the first start trigger, 0
    without one; file is null where none fits. Files meet recordings by subject and paradigm only, a few of each.
    """
    told = behaviour.select(F.col("subject").alias("_s"), F.col("paradigm").alias("_p"), F.coalesce("block", F.lit("")).alias("_b"), F.col("path").alias("file"))
    fits = (F.col("subject") == F.col("_s")) & (F.col("paradigm") == F.col("_p")) & F.contains(F.lower("variant"), F.lower("_b"))
    files = recorded.select("recording", "subject", "paradigm", "variant").join(told, fits).groupBy("recording").agg(F.min("file").alias("file"))
    first = triggers.join(recorded.select("recording", "paradigm"), "recording").join(starts.distinct(), ["paradigm", "code"], "left_semi").groupBy("recording").agg(F.min("time").alias("offset"))
    return recorded.join(files, "recording", "left").join(first, "recording", "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))
