"""URL filters: a fixed rule list, and association rules mined from labels for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import sent_if_small, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, start of the path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "label:bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Labelled urls that a token combination needs, however few there are.
MIN_ROWS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without '://'."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null. A host fits its subdomains."""
    out = F.lit(None)
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host by dot and hyphen, parts of the path by any punctuation."""
    part = lambda prefix, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return F.array_distinct(F.concat(part("h:", F.split(host, r"[.-]")), part("p:", F.split(F.lower(path), r"[^\p{L}\p{N}]+"))))


def mine_rules(baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, antecedent, confidence, support of the rules 'these tokens, so the label is bad'.

    FP-growth runs over (tokens, bad) rows. A token that is too rare among bad urls is in no rule, so
    it is left out first, and tokens that always occur together (the parts of one host) are mined as
    one and told as all of them: what is left of a basket is bounded by the support, not by a cap, and
    such groups make no combinations. Of rules where one's tokens hold another's that is as sure, only
    the shorter one stays.
    """
    rows = stored(baskets.select("tokens", "bad").withColumn("_row", F.monotonically_increasing_id()), "url-baskets")
    n = rows.count()
    support = min(1.0, max(min_support, MIN_ROWS / max(n, 1)))
    posted = rows.select("_row", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    held = posted.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("_row")).alias("rows"))
    frequent = held.filter(F.col("n_bad") >= support * n)
    together = stored(frequent.groupBy("n", "rows").agg(F.min("token").alias("token"), F.sort_array(F.collect_list("token")).alias("all")).select("token", "all"), "url-tokens")
    kept = posted.join(sent_if_small(together.select("token"), 100), "token").groupBy("_row").agg(F.collect_list("token").alias("kept"))
    items = rows.select("_row", "bad").join(kept, "_row", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    items = items.select(F.when(F.col("bad"), F.array_append("kept", F.lit(BAD))).otherwise(F.col("kept")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(stored(items, "url-items"))
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    whole = rules.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), "confidence", "support", F.explode("antecedent").alias("token")).join(together, "token")
    whole = whole.groupBy("rule_id", "confidence", "support").agg(F.sort_array(F.flatten(F.collect_list("all"))).alias("antecedent"))
    whole = stored(whole, "url-mined")
    shorter = met_rules(whole.select(F.col("rule_id").alias("_long"), F.col("antecedent").alias("tokens"), F.col("confidence").alias("_sure")), whole, "_long", "tokens", "_sure")
    beaten = shorter.filter((F.col("_long") != F.col("rule_id")) & (F.col("confidence") >= F.col("_sure"))).select(F.col("_long").alias("rule_id")).distinct()
    return whole.join(beaten, "rule_id", "left_anti")


def met_rules(rows: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """The columns kept of rows (with tokens), rule_id and confidence for every stored rule whose tokens a row holds.

    Inverted index: a rule is posted under its rarest token only, so a row meets a rule where it
    holds that token, and the other tokens are checked then. The index is bounded by the support and
    sent to every task where it is small, so no token gathers rows.
    """
    wanted = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    n_rules = rules.count()
    counts = rows.select(F.explode("tokens").alias("token")).join(sent_if_small(wanted.select("token").distinct(), 100, 20 * n_rules), "token", "left_semi").groupBy("token").count()
    index = (
        wanted.join(counts, "token")
        .groupBy("rule_id", "antecedent", "confidence")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    met = rows.select(*keep, F.col("tokens").alias("_held"), F.explode("tokens").alias("token")).join(sent_if_small(index, 400, n_rules), "token")
    return met.filter(F.size(F.array_except("antecedent", "_held")) == 0).select(*keep, "rule_id", "confidence")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence of the surest rule that fits it, from (url, tokens)."""
    return met_rules(urls, rules, "url").groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence.

    The longest fixed rule decides; else a page is blocked where a mined rule fits and allowed where
    none does; of several that fit the surest gives the confidence, and ties there change nothing.
    Labels join pages by id (bad: low quality or toxic; null is neither). A page id with several labels
    is bad if one is; null ids have no label. Without labels, or with good ones only, there are no
    mined rules. Null urls have empty host and path and no tokens; very long urls are read whole.
    Verdicts are made per distinct url, so repeated rows cost one; extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"))).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("_bad"))
    basket = rows.join(labelled, "page_id").select("tokens", F.col("_bad").alias("bad"))
    rules = stored(mine_rules(basket, min_support, min_confidence), "url-rules")
    free = rows.filter(F.col("_fixed").isNull() & (F.size("tokens") > 0)).groupBy("url").agg(F.first("tokens").alias("tokens"))
    hit = match_rules(free, rules)
    out = rows.join(hit, "url", "left")
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_fixed").isNull(), F.col("confidence")).alias("confidence"))


def op8_url_rules(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
