"""Configurations and projects as documents, and what is wrong with them as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand at a place of a configuration, and whether anything else is an error or a warning.
CHOICES = {
    "ica_method": ("$.preprocessing.ica_method", "error", ("infomax", "extended_infomax", "picard", "fastica")),
    "source_method": ("$.source.method", "error", ("dSPM", "sLORETA", "eLORETA", "MNE", "LCMV", "DICS")),
    "connectivity_method": ("$.connectivity.methods", "warning", ("correlation", "partial_correlation", "spearman", "plv", "pli", "wpli", "coherence", "imcoh", "mi", "transfer_entropy")),
    "prediction_type": ("$.prediction.prediction_type", "error", ("within_subject", "between_subject", "between_group")),
    "cv_strategy": ("$.prediction.cv_strategy", "error", ("kfold", "leave_one_out", "stratified_kfold", "group_kfold")),
}
PROJECT = "struct<root: string, subjects: array<struct<id: string, sessions: array<struct<id: string, runs: array<struct<id: string, file: string>>>>>>>"
ISSUE = "struct<rule: string, severity: string, place: string, detail: string>"


def _issue(when: Column, rule: str, severity: str, place: str, detail: Column) -> Column:
    """An array of one issue where the condition holds, else empty."""
    one = F.struct(F.lit(rule), F.lit(severity), F.lit(place), detail.cast("string")).cast(ISSUE)
    return F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def config_issues(configs: DataFrame, key: str = "id", document: str = "document") -> DataFrame:
    """key, rule, severity, place, detail: a row for each rule that a JSON document breaks.

    A document that isn't JSON breaks the rule document. A setting that is absent, or of another type,
    has its default and breaks none. All rules are one projection over the parsed document; no document is looked at twice.
    """
    rows = configs.select(F.col(key), F.col(document).isNotNull().alias("_given"), F.try_parse_json(document).alias("_v"))
    number = lambda path: F.try_variant_get("_v", path, "double")
    low, high = number("$.preprocessing.l_freq"), number("$.preprocessing.h_freq")
    start, stop = number("$.epochs.tmin"), number("$.epochs.tmax")
    first, last = number("$.epochs.baseline[0]"), number("$.epochs.baseline[1]")
    both = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    found = [
        _issue(F.col("_v").isNull(), "document", "error", "$", F.lit(None)),
        _issue(low >= high, "frequency_order", "error", "$.preprocessing", both(low, high)),
        _issue(start >= stop, "epoch_order", "error", "$.epochs", both(start, stop)),
        _issue((first < start) | (last > stop), "baseline_window", "warning", "$.epochs.baseline", both(first, last)),
    ]
    for rule, (place, severity, known) in CHOICES.items():
        if rule == "connectivity_method":
            said = F.try_variant_get("_v", place, "array<string>")
            odd = F.filter(said, lambda m: ~m.isin(*known))
            each = F.transform(F.coalesce(odd, F.array().cast("array<string>")), lambda m: F.struct(F.lit(rule), F.lit(severity), F.lit(place), m).cast(ISSUE))  # noqa: B023
            found.append(each)
        else:
            said = F.try_variant_get("_v", place, "string")
            found.append(_issue(~said.isin(*known), rule, severity, place, said))
    return rows.select(key, F.explode(F.concat(*found)).alias("_i")).select(key, "_i.*")


def project_issues(projects: DataFrame, places: DataFrame, key: str = "id", document: str = "document") -> DataFrame:
    """key, rule, severity, place, detail of projects: missing roots and files, subjects and sessions there are none of.

    A document: {"root", "subjects": [{"id", "sessions": [{"id", "runs": [{"id", "file"}]}]}]}. places: path, the folders
    and files there are. Of a project without its root only that is said. Roots and files are
    looked up by joins.
    """
    known = places.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    rows = projects.select(F.col(key), F.from_json(document, PROJECT).alias("_p"))
    rooted = rows.join(known, F.col("_p.root") == F.col("_path"), "left").withColumn("_root", F.coalesce("_there", F.lit(False))).drop("_there", "_path")
    people = F.coalesce("_p.subjects", F.array().cast("array<struct<id: string, sessions: array<struct<id: string, runs: array<struct<id: string, file: string>>>>>>"))
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    bare = F.transform(F.filter(people, lambda s: none(s["sessions"])), lambda s: F.struct(F.lit("no_sessions"), F.lit("warning"), s["id"], F.lit(None)).cast(ISSUE))
    said = F.when(~F.col("_root"), _issue(F.lit(True), "no_root", "error", "root", F.col("_p.root"))).otherwise(F.concat(_issue(none(people), "no_subjects", "warning", "subjects", F.lit(None)), bare))
    plain = rooted.select(key, F.explode(said).alias("_i")).select(key, "_i.*")
    runs = rooted.filter("_root").select(key, F.explode(people).alias("s")).select(key, F.col("s.id").alias("subject"), F.explode("s.sessions").alias("e")).select(key, "subject", F.col("e.id").alias("session"), F.explode("e.runs").alias("r"))
    lost = runs.join(known, F.col("r.file") == F.col("_path"), "left_anti")
    files = lost.select(key, F.lit("no_file").alias("rule"), F.lit("error").alias("severity"), F.concat_ws("/", "subject", "session", "r.id").alias("place"), F.col("r.file").alias("detail"))
    return plain.unionByName(files)


def verdicts(documents: DataFrame, issues: DataFrame, key: str = "id") -> DataFrame:
    """key, valid, n_errors, n_warnings of every document, those without issues too."""
    n = lambda severity: F.count_if(F.col("severity") == severity)
    by = issues.groupBy(key).agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select(key).join(by, key, "left").select(key, (F.coalesce("n_errors", F.lit(0)) == 0).alias("valid"), zero("n_errors"), zero("n_warnings"))
