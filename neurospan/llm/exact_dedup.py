"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import sent_if_small, stored, table, text_or_empty

PREFIX_CHARS = 256
#: Bytes of a surviving prefix, and of a group or verdict with its hash, in a table that is sent to every task.
PREFIX_ROW, HASH_ROW = 40, 160


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of two or more equal texts: n_bytes, prefix_hash, full_hash, keep_id, group_size.

    Only lengths that occur twice have their prefixes hashed, and only (length, prefix) pairs that
    occur twice have their texts hashed. Every step counts with map-side partial aggregates, so a
    group of any size reaches the reducers as one row a task.
    """
    text = text_or_empty(text_col)
    lengths = docs.select(F.octet_length(text).alias("n_bytes")).groupBy("n_bytes").count().filter("count > 1").select("n_bytes")
    prefix = F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash")
    prefixes = (
        docs.select(F.octet_length(text).alias("n_bytes"), prefix)
        .groupBy("n_bytes", "prefix_hash").count().filter("count > 1")
        .join(lengths, "n_bytes", "left_semi").select("n_bytes", "prefix_hash")
    )
    prefixes = stored(prefixes, "copies-prefixes")
    wanted = sent_if_small(prefixes, PREFIX_ROW)
    survivors = docs.select(F.octet_length(text).alias("n_bytes"), prefix, F.col(id_col).alias("_id"), F.sha2(text, 256).alias("full_hash"))
    return (
        survivors.join(wanted, ["n_bytes", "prefix_hash"], "left_semi")
        .groupBy("n_bytes", "prefix_hash", "full_hash")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty, so nulls and
    empty texts form one group. Rows that repeat a doc_id with the same text count in group_size and
    share the verdict. A null doc_id never wins over a value; alone, it keeps itself. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
        F.sha2(text, 256).alias("full_hash"),
    )
    groups = stored(exact_groups(docs, id_col, text_col, prefix_chars), "copies-groups")
    side = sent_if_small(groups, HASH_ROW)
    joined = rows.join(side, ["n_bytes", "prefix_hash", "full_hash"], "left")
    keep = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("full_hash").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of equal texts the row with the largest doc_id stays.

    Rows that repeat a doc_id with its text are copies too, and one of them stays. Rows with a null
    doc_id can't be told apart by a verdict and stay unless a row with an id has their text.
    """
    judged = stored(exact_dedup(docs).select(F.col("doc_id").alias("_verdict_id"), F.col("text_sha256").alias("_verdict_sha"), "kept"), "copies-verdicts")
    # what is dropped or repeated is judged by id and text, so a repeated id doesn't drop other texts
    twice = judged.filter("kept and _verdict_id is not null").groupBy("_verdict_id", "_verdict_sha").count().filter("count > 1").select("_verdict_id", "_verdict_sha")
    gone = stored(judged.filter("not kept").select("_verdict_id", "_verdict_sha").distinct(), "copies-gone")
    twice = stored(twice, "copies-twice")
    sha = F.sha2(text_or_empty(), 256)

    def meets(rows: DataFrame, how: str, left: DataFrame) -> DataFrame:
        side = sent_if_small(rows, HASH_ROW)
        return left.join(side, left["doc_id"].eqNullSafe(F.col("_verdict_id")) & (sha == F.col("_verdict_sha")), how)

    rest = meets(gone, "left_anti", docs)
    if twice.limit(1).count() == 0:
        return rest
    return meets(twice, "left_anti", rest).unionByName(meets(twice, "left_semi", rest).dropDuplicates(["doc_id", "text"]))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
