"""Periodic runs of words: Lyndon factors under both orders give every maximal repetition of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm.common import WORD, lean, small_batches, table, text_or_empty

#: Words of the shortest run.
LEAST = 12
#: Words compared one by one before hashes are asked.
NEAR = 8
#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)

WORDS = re.compile(WORD)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of words that lie in a repeated gram of half the least length.

    A run of period q repeats least / 2 words or more at distance q, and all its words lie in grams of
    that length that occur at distance q too. So every run lies in one stretch, with its neighbours
    beyond its ends where those could extend it. Grams are known by hash; a collision only adds words.
    """
    gram = -(-least // 2)
    n = len(ids) - gram + 1
    if n < 2:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + gram, -1)
    inside = np.concatenate([[0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(z)) for a, z in zip(turns[::2], turns[1::2], strict=True) if z - a >= least]


class Extents:
    """How far words agree at two places of a sequence, to the right and to the left.

    The first NEAR words are compared one by one; beyond them a binary search over rolling hashes
    proposes the extent, and the words themselves are compared over it. What was compared at one
    distance is remembered, so within a run words are compared once, not once for each place.
    """

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.prefix: list[int] = [0]
        self.power: list[int] = [1]
        h, p = 0, 1
        for x in ids:
            h = (h * BASE + x + 1) % PRIME
            p = p * BASE % PRIME
            self.prefix.append(h)
            self.power.append(p)
        self.seen: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j have one hash."""
        h, p = self.prefix, self.power[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """Words from i on that equal those from j on, i < j."""
        ids, n, d = self.ids, self.n, j - i
        if j >= n or ids[i] != ids[j]:
            return 0
        a, b = self.seen.get(d, (n, n))
        if a <= i < b:
            return b - i
        k, stop = i + 1, min(i + NEAR, n - d)
        while k < stop and k != a and ids[k] == ids[k + d]:
            k += 1
        if k == a and a < b:  # the rest was compared before
            self.seen[d] = (i, b)
            return b - i
        if k < stop or k == n - d:
            if k - i > NEAR // 2:
                self.seen[d] = (i, k)
            return k - i
        low, high = k - i, n - j  # agree on low words, at most on high
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, j, middle):
                low = middle
            else:
                high = middle - 1
        end = i + low
        known = i < a <= end and b == end  # the words from a on were compared before
        until = a if known else end
        if ids[i:until] != ids[i + d : until + d]:  # a collision
            end = i
            while end < n - d and ids[end] == ids[end + d]:
                end += 1
        self.seen[d] = (i, end)
        return end - i

    def left(self, i: int, j: int) -> int:
        """Words before i that equal those before j, i < j."""
        ids, d, k = self.ids, j - i, 0
        while k < NEAR and k < i and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        if k < NEAR or k == i:
            return k
        low, high = k, i
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i - middle, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        if ids[i - low : i] != ids[i - low + d : i + d]:  # a collision
            low = 0
            while low < i and ids[i - 1 - low] == ids[j - 1 - low]:
                low += 1
        return low


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Every run of the sequence as (start, length, period), sorted by start, then period.

    From right to left a stack holds the starts of Lyndon factors; the word at i opens a factor that
    swallows the factors after it as long as its suffix is the smaller one, under the order of ids and
    under its reverse. A run's period is the length of such a factor under one of the orders, so each
    factor is extended to both sides and kept where it is repeated.
    """
    n, extents = len(ids), Extents(ids)
    found: set[tuple[int, int, int]] = set()
    last: dict[int, tuple[int, int]] = {}
    for ascending in (True, False):
        stack = [n]
        for i in range(n - 1, -1, -1):
            while stack[-1] < n:
                j = stack[-1]
                k = extents.right(i, j)
                if j + k == n or (ids[i + k] < ids[j + k]) is not ascending:
                    break  # the suffix at j is the smaller one
                stack.pop()
            j = stack[-1]
            stack.append(i)
            p = j - i
            if (j == n or ids[i] != ids[j]) and (i == 0 or ids[i - 1] != ids[j - 1]):
                continue  # the factor stands alone
            start, end = last.get(p, (n, n))
            if start <= i and j <= end:
                continue  # inside a run of this period
            start, end = i - extents.left(i, j), j + extents.right(i, j)
            if end - start >= max(least, 2 * p):
                last[p] = (start, end)
                found.add((start, end - start, p))
        last.clear()
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence of words, numbered from 0."""
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out: list[tuple[int, int, int]] = []
    for a, z in stretches(ids, least):
        out += [(a + start, length, period) for start, length, period in runs_of(ids[a:z].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: id_col, n_words, runs (array of start, length, period), collapsed (text).

    A run is a maximal stretch of least words or more that repeats its first period words at least
    once; starts are word numbers from 0, runs are sorted by start, then period. collapsed holds the words
    that no run contains after its first period, joined by one space. A null or empty text, or one of
    white space, has no words, no runs and an empty collapsed text. Every row is judged by itself, rows that
    repeat an id or a text too; other columns are ignored, whatever their names. An empty table gives no rows.

    A task holds one batch of texts; the work on a text grows about as n log n with its words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text)
                found = text_runs(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by checksum of the id, turned periodic from one of their words on.

    With h the checksum and g = h // 10, the words from number a = g mod n on become the first
    1 + (n - a) // (3 + g mod 8) of them over and over, where h mod 10 is 0. A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    copies = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), copies)), F.lit(1), (n - a).cast("int"))
    turned = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(WORD)), turned).otherwise(text)


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs and of the kept words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), text_or_empty()).alias("text"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return out.selectExpr(
        "doc_id", "n_runs", "_best.start AS start", "-_best.n AS length", "_best.period AS period",
        "-1000 * _best.n div _best.period AS exponent_milli", "runs_sha256", "collapsed_sha256")
