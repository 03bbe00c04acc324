"""Secret scans: base patterns, plus corpus-wide ownership of every candidate value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.llm.common import stored, table, text_or_empty

#: kind, pattern, shortest length that counts, group measured. Base kinds first, in order.
BASE = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24, 0),
)
#: A private key up to its END line; where that is missing, its header and what follows in long base64 pieces.
KEY_HEAD, KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
KEY = rf"{KEY_HEAD}((?:[^-]|-(?!----))*+(?={KEY_END})|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)*+)(?:{KEY_END})?"
#: Further shapes; a span of these counts only where its value looks live.
MORE = (
    ("key", KEY, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("prefixed", r"(?<![A-Za-z0-9])(?:gh[pousr]_|xox[abpr]-|sk_live_|glpat-)[A-Za-z0-9-]{16,}", 0, 0),
)
KINDS = tuple(k for k, *_ in BASE + MORE)
#: Strings one of which any match of a kind holds: a text without them is not searched.
HINTS = {"access": ("AKIA",), "key": ("-----BEGIN",), "jwt": ("eyJ",), "prefixed": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "glpat-")}
#: A value that more owners than this, or more repositories of several owners, share is an example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 8


MATCH = "array<struct<kind:string,i:int,step:long,length:long,value:string>>"


def matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches in order: their number, value, length, and the code points from the end of the match before to their own.

    One struct a match, made by one pass each over the matches and the pieces between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"), found.alias("m"), value.alias("v"))
    items = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), (F.length(x["g"]) + F.length(x["m"])).cast("long").alias("step"), F.length(x["m"]).cast("long").alias("length"), x["v"].alias("value")))
    held = F.lit(False)
    for hint in HINTS.get(kind, ()):
        held = held | F.contains(text, F.lit(hint))
    worth = F.size(found) > 0
    return F.when(held & worth if kind in HINTS else worth, items).otherwise(F.array().cast(MATCH))


def joined(items: Column) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("s"), rank(x).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, base (spans), live, examples (spans by ownership), spans.

    Every candidate value's hash is counted over the corpus by distinct owner and distinct
    repository. A value that more owners hold than the limit, or several owners in more repositories
    than the limit, is an example that was copied around; the rest looks live, also where one owner
    alone holds many copies. A private key's value is its body without white space, so neither the
    header nor the wrapping of lines tells keys apart. Base spans are always reported, the further shapes only
    where they look live. A null or empty text has no spans; a null owner is one owner; rows that
    repeat a document count once as repository. Hot values meet partial aggregates by (value,
    owner) and (value, repository) first, so no task collects a value's holders. A very long text with
    very many matches costs time in proportion to them: positions are running sums over its matches.
    Spans that start together are told in the order of the kinds.
    """
    text = text_or_empty()
    found = F.concat(*[matches(F.col("_text"), kind, pattern, group) for kind, pattern, _, group in BASE + MORE])
    rows = docs.select(F.col("doc_id"), F.col(repository).alias("_repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), text.alias("_text"))
    # the row's number ties a document's candidates together again even where doc_id repeats
    rows = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_repo", "_owner", found.alias("found")), "secret-spans")
    hits = rows.filter(F.size("found") > 0).select("_row", "_repo", "_owner", F.inline("found"))
    end = F.sum("step").over(W.partitionBy("_row", "kind").orderBy("i"))
    least = F.element_at(F.create_map(*[F.lit(y) for kind, _, n, _ in BASE + MORE for y in (kind, n)]), F.col("kind"))
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).filter(F.length("value") >= least)
    hits = hits.select("_row", "_repo", "_owner", F.struct("kind", "start", "end").alias("x"), F.sha2(F.regexp_replace("value", r"\s|\\[nr]", ""), 256).alias("_hash"))
    hits = stored(hits, "secret-hits")
    owners = hits.groupBy("_hash", "_owner").agg(F.lit(1)).groupBy("_hash").agg(F.count("*").alias("n_owners"))
    repos = hits.groupBy("_hash", "_repo").agg(F.lit(1)).groupBy("_hash").agg(F.count("*").alias("n_repos"))
    held = owners.join(repos, "_hash")
    live = (F.col("n_owners") <= max_owners) & ((F.col("n_owners") == 1) | (F.col("n_repos") <= max_repositories))
    judged = hits.join(held.select("_hash", live.alias("live")), "_hash").groupBy("_row").agg(
        F.collect_list(F.struct("x.kind", "x.start", "x.end", "live")).alias("judged")
    )
    base = [k for k, *_ in BASE]
    none = F.array().cast("array<struct<kind:string,start:long,end:long,live:boolean>>")
    all_ = F.coalesce("judged", none)
    out = rows.select("_row", "doc_id").join(judged, "_row", "left")
    return out.select(
        "doc_id",
        F.filter(all_, lambda x: x["kind"].isin(base)).alias("base"),
        F.filter(all_, lambda x: x["live"]).alias("live"),
        F.filter(all_, lambda x: ~x["live"]).alias("examples"),
        F.filter(all_, lambda x: x["kind"].isin(base) | x["live"]).alias("spans"),
    )


def op9_secret_ownership(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k, *_ in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("examples").cast("long").alias("n_examples"),
    )


def _pieces(kind: str, pattern: str, least: int, group: int) -> str:
    pattern = pattern.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9])", "").replace("'", "''")
    value = f"regexp_replace(v, '{KEY_HEAD}|{KEY_END}', '', 'g')" if kind == "key" else "v"
    return f"""
  SELECT r, doc_id, source, '{kind}' AS kind, {KINDS.index(kind)} AS k, s, s + length(m) AS e, regexp_replace({value}, '[\\s\\x0B]|\\\\[nr]', '', 'g') AS v FROM (
    SELECT r, doc_id, source, m, v, CAST(sum(length(g)) OVER (PARTITION BY r ORDER BY i) + sum(length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS BIGINT) AS s
    FROM (SELECT r, doc_id, source, unnest(list_zip(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))], regexp_extract_all(t, '{pattern}'), regexp_extract_all(t, '{pattern}', {group}), range(1, 1 + len(regexp_extract_all(t, '{pattern}')))), recursive := false) AS z FROM d), LATERAL (SELECT z[1] AS g, z[2] AS m, z[3] AS v, z[4] AS i))
  WHERE length(v) >= {least}"""


#: A key for the SQL, whose regular expressions have no lookahead: what lies between its lines is cut out of the match.
KEY_SQL = rf"{KEY_HEAD}(?:(?:[^-]|-{{1,4}}[^-])*{KEY_END}|(?:(?:[\s\x0B]|\\[nr])*[A-Za-z0-9+/=]{{16,}})*)"
SQL_SHAPES = tuple((k, KEY_SQL, 0, 0) if k == "key" else (k, *x) for k, *x in BASE + MORE)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(_pieces(*p) for p in SQL_SHAPES)}),
h AS (SELECT v, count(DISTINCT source) <= {MAX_OWNERS} AND (count(DISTINCT source) = 1 OR count(DISTINCT doc_id) <= {MAX_REPOSITORIES}) AS live FROM x GROUP BY v),
y AS (SELECT x.*, live FROM x JOIN h USING (v)),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS b,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)} OR live), '') AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples
  FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN g USING (r)
"""
