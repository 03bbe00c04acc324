"""Best-fit packing under conflicts: residual-ordered bins with source and cluster bitmaps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import n_words, stored, table, text_or_empty

CAPACITY = 4096
PER_SOURCE = 6
SHARD_WORDS = 1_000_000
#: What a short document counts for when shards are sized, so a shard holds no more than about 20,000 pieces.
LEAST_LOAD = 50


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each item, items taken in the order given; sizes lie between 1 and the capacity.

    Bins hang under their residual, and an integer with a bit for each residual in use gives the
    successor: the least residual that holds the item. A bin whose bitmaps show the item's cluster,
    or its source at the quota, is passed over, and the search goes on to the next bin and the next
    residual. So the item lands in the tightest compatible bin, the oldest of equals.
    """
    seen: dict[int, int] = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bit: dict[int, int] = {}
    for c, n in seen.items():
        if n > 1:  # a cluster with one member here conflicts with nothing
            bit[c] = 1 << len(bit)
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    full: list[int] = []  # sources at their quota, by bin
    held: list[int] = []  # clusters, by bin
    counts: list[dict[int, int]] = []
    under: dict[int, list[int]] = {}
    used, out = 0, []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c, found, residual = source_bit[source], bit.get(cluster, 0), -1, capacity
        ahead = used >> size
        while ahead and found < 0:
            low = ahead & -ahead
            residual = size + low.bit_length() - 1
            for b in under[residual]:
                if not (held[b] & c or full[b] & s):
                    found = b
                    break
            ahead ^= low
        if found < 0:
            found, residual = len(full), capacity
            full.append(0), held.append(0), counts.append({})
        else:
            under[residual].remove(found)
            if not under[residual]:
                used ^= 1 << residual
        held[found] |= c
        n = counts[found][source] = counts[found].get(source, 0) + 1
        if n >= per_source:
            full[found] |= s
        rest = residual - size
        if rest:
            under.setdefault(rest, []).append(found)
            used |= 1 << rest
        out.append(found)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, row, piece, first_word, n_words, bin_id, slot.

    A document longer than the capacity is cut into full pieces and a rest. Pieces are dealt by a
    hash of row and piece to shards of about shard_words words (a short document counts for
    LEAST_LOAD), so the number of shards, not their size, grows with the corpus and no source, id or
    cluster decides where a piece goes; each shard is packed best-fit in decreasing size. No bin holds
    two pieces of one duplicate cluster (equal texts, or cluster_col) or more than per_source pieces of
    one source.

    row numbers the rows of docs; rows that repeat a document are copies of one cluster. A document
    without words (null text too) gives one row with a null bin. A null source is a source. Ties in
    size go by doc_id, piece and row.
    """
    text = text_or_empty()
    cluster = F.col(cluster_col).cast("string") if cluster_col else text
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(cluster).alias("cluster"))
    rows = stored(rows, "pack-sizes")
    total = rows.agg(F.sum(F.greatest("size", F.lit(LEAST_LOAD)))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id", "row", "source", "cluster", "piece",
        (F.col("piece") * F.lit(capacity)).cast("long").alias("first_word"),
        F.least(F.lit(capacity), F.col("size") - F.col("piece") * F.lit(capacity)).cast("long").alias("n_words"),
    )
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(7)), F.lit(shards)).cast("int"))

    def shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        real = (frame["n_words"] > 0).to_numpy()
        where = best_fit(frame.loc[real, "n_words"].tolist(), pd.factorize(frame.loc[real, "source"], use_na_sentinel=False)[0].tolist(), frame.loc[real, "cluster"].tolist(), capacity, per_source)
        bins = np.full(len(frame), -1, "int64")
        bins[real] = (int(key[0]) << 40) + np.array(where, "int64")
        frame["bin_id"] = pd.Series(bins, index=frame.index).astype("Int64").where(real)
        frame["slot"] = frame.groupby(bins).cumcount().astype("Int32").where(real)
        return frame[["doc_id", "row", "piece", "first_word", "n_words", "bin_id", "slot"]]

    return pieces.groupBy("shard").applyInPandas(shard, "doc_id long, row long, piece int, first_word long, n_words long, bin_id long, slot int")


def op6_best_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
