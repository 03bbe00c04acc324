"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior, joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import SPACE, WORD, sent_if_small, stored, table, text_or_empty

SYMBOLS = r"[#*$%&|<>]+"
A_WORD = r"[^\x20\x09-\x0D]"
#: Rules as SQL over the measures: (name, what makes a document suspect, the measured ratio, where suspicion starts, where it is full).
RULES = (
    ("symbols", "10 * n_symbols > n_words", "CAST(n_symbols AS DOUBLE) / greatest(n_words, 1)", 0.1, 0.3),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1)", 0.3, 0.4),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)", 0.3, 0.5),
    ("long_words", "word_chars > 12 * n_words", "CAST(word_chars AS DOUBLE) / greatest(n_words, 1)", 12, 20),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words", "2.0 - CAST(word_chars AS DOUBLE) / greatest(n_words, 1)", 0, 1),
    ("short", "n_words < 50", "50.0 - n_words", 0, 50),
)
FAILED = " OR ".join(f"({suspect})" for _, suspect, *_ in RULES)
#: A document's score: a half for each rule it is suspect by, up to one where the suspicion is full.
SCORE = " + ".join(
    f"CASE WHEN {suspect} THEN CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), ({x} - CAST({start} AS DOUBLE)) / CAST({full - start:.6g} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"
    for _, suspect, x, start, full in RULES
)


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words (column _words) inside 3-word windows that occur twice or more.

    Window hashes are sorted with their positions, equal neighbours give the windows that repeat,
    and each marks three words. Only texts with an equal pair are sorted. Each array is a column of
    its own, so it is made once.
    """
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1)))
    df = df.withColumn("_hashes", F.when(n > 3, hashes))
    repeats = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    df = df.withColumn("_pairs", F.when(repeats, pairs))
    size = F.size("_pairs")
    none = F.array().cast("array<int>")
    both = F.zip_with(F.slice("_pairs", F.lit(1), size - 1), F.slice("_pairs", F.lit(2), size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    df = df.withColumn("_again", F.when(F.col("_pairs").isNotNull(), F.flatten(both)))
    marked = F.array_distinct(F.flatten(F.transform("_again", lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumn("n_repeat_words", F.when(F.col("_again").isNotNull(), F.size(marked)).otherwise(0).cast("long"))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and what the rules look at. Null texts have no words and no lines."""
    text = text_or_empty()
    base = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("_t"))
    base = base.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    base = base.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.rlike(x, F.lit(A_WORD))))
    base = with_repeats(base)
    return base.select(
        "doc_id", "host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """host, rate from (host, failed): (failures + a) / (documents + a + b).

    a and b fit a beta distribution to the hosts' raw rates by their mean and variance, weighted by
    documents; without spread between hosts the prior has the weight of the mean host.
    """
    per = stored(judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("k")), "quality-hosts")
    total = per.agg(F.sum("n").cast("double").alias("n"), (F.sum("k") / F.sum("n")).alias("m"), F.avg("n").alias("mean_n")).first()
    if not total["n"]:
        return per.select("host", F.lit(None).cast("double").alias("rate"))
    p, m = F.col("k") / F.col("n"), total["m"]
    spread = per.agg(F.sum(F.col("n") * (p - m) * (p - m))).first()[0] / total["n"]
    between = spread - m * (1 - m) / total["mean_n"]
    strength = max(m * (1 - m) / between - 1, 1.0) if between > 1e-12 else total["mean_n"]
    return per.select("host", ((F.col("k") + m * strength) / (F.col("n") + strength)).alias("rate"))


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every document's measures with failed (suspect by any rule), score, host_rate, host_ok and kept.

    A host's verdict is the share of its documents that fail, shrunk towards all hosts; what that
    leaves to doubt, one less the rate, is the score up to which its documents are kept. So where
    half of a host fails every suspect document goes, and the better a host is the surer a suspicion
    must be; two suspicions, or one in full, are too much on any. Clean documents of bad hosts stay.
    host_ok says whether a host keeps documents with one slight suspicion. A null host is one host; an
    empty text fails; a table without rows gives none.
    """
    rows = stored(measures(docs, host), "quality-measures")
    rows = rows.withColumn("failed", F.expr(FAILED)).withColumn("score", F.expr(SCORE))
    rates = stored(host_rates(rows).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "quality-rates")
    rows = rows.join(sent_if_small(rates, 200), rows["host"].eqNullSafe(rates["_host"])).drop("_host")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~base_failed & (~F.col("failed") | (F.col("score") <= 1 - F.col("host_rate")))
    return rows.withColumn("base_failed", base_failed).withColumn("host_ok", F.col("host_rate") < 0.5).withColumn("kept", kept)


def op10_host_rules(spark, sf_dir):
    rows = host_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok", F.round("host_rate", 9).alias("host_rate"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN p USING (r)),
f AS (SELECT *, {FAILED} AS failed, {SCORE} AS score FROM m),
per AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY host),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, CAST(sum(k) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS m, avg(n) AS mean_n FROM per),
var AS (SELECT m, mean_n, (SELECT sum(n * (k / n - tot.m) * (k / n - tot.m)) FROM per) / nn - m * (1 - m) / mean_n AS b FROM tot),
pri AS (SELECT m, CASE WHEN b > 1e-12 THEN greatest(m * (1 - m) / b - 1, 1.0) ELSE mean_n END AS w FROM var),
rate AS (SELECT host, (k + m * w) / (n + w) AS rate FROM per, pri),
j AS (SELECT f.*, rate, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, rate < 0.5 AS host_ok FROM f JOIN rate ON f.host IS NOT DISTINCT FROM rate.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (NOT failed OR score <= 1 - rate) AS kept, host_ok, round(rate, 9) AS host_rate FROM j
"""
