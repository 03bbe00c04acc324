"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters, so the n-gram tables are bounded by the writing systems, not by the
vocabulary, and whole texts can be counted. Tables are DataFrames keyed by packed n-grams; the
probabilities come from joins of counts, spread over the shuffle partitions by n-gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurospan.llm.common import lean, sent_if_small, small_batches, stored, table, text_or_empty, trim

ORDER = 5
BITS = 21  # per symbol: every code point is its own, 0 pads the start of a text
NUL = 0x110000  # stands for the character 0
#: An n-gram is two longs: lo packs its last LOW symbols, hi those before them.
LOW = 3
KEY = ["hi", "lo"]
Pairs = tuple[np.ndarray, np.ndarray]
CHUNK = 1 << 19
#: Logarithms are whole numbers of 1/SCALE, so sums of them don't depend on the order or the path.
SCALE = 1 << 24
#: Bytes of a model (MODEL_ROW for each n-gram and context) that is sent to every task; a larger one is joined by shuffle.
MAX_SENT_BYTES, MODEL_ROW = 48 << 20, 12
#: Bytes of a trusted id, and of a language's threshold, in a table that is sent to every task.
ID_ROW, LANG_ROW = 32, 100
QUANTILE = 0.99
LEAST_CALIBRATION = 20


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes == 0, NUL, codes)


def pack(texts: list[str]) -> tuple[Pairs, np.ndarray]:
    """The packed n-gram that ends at each character of the texts in turn, and the texts' lengths."""
    pad = np.zeros(ORDER - 1, np.int64)
    parts, lengths = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        codes = symbols(text)
        lengths[i] = len(codes)
        parts += [pad, codes]
    c = np.concatenate([*parts, pad[:0]]) if parts else pad
    if len(c) < ORDER:
        return (np.empty(0, np.int64), np.empty(0, np.int64)), lengths
    at = np.flatnonzero(c[ORDER - 1 :])

    def packed(first: int, last: int) -> np.ndarray:
        keys = c[at + first]
        for k in range(first + 1, last):
            keys <<= BITS
            keys |= c[at + k]
        return keys

    return (packed(0, ORDER - LOW), packed(ORDER - LOW, ORDER)), lengths


def distinct(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each occurs, or the sum of its n."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(hi)), bool), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    if n is None:
        return hi[first], lo[first], np.diff(np.append(first, len(hi)))
    return hi[first], lo[first], np.add.reduceat(n[order], first) if len(first) else n[order]


def chunks(texts: list[str]) -> Iterator[list[int]]:
    """Runs of texts with about CHUNK characters together; a longer text is a run of its own."""
    run, total = [], 0
    for i, text in enumerate(texts):
        if run and total + len(text) > CHUNK:
            yield run
            run, total = [], 0
        run.append(i)
        total += len(text)
    if run:
        yield run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Counts = tuple[np.ndarray, np.ndarray, np.ndarray]

    def merged(parts: list[Counts]) -> Counts:
        return distinct(*map(np.concatenate, zip(*parts, strict=True)))

    def out(part: Counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=[*KEY, "n"])

    lean()
    parts: list[Counts] = []
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for run in chunks(texts):
            parts.append(distinct(*pack([texts[i] for i in run])[0]))
            if sum(len(x[0]) for x in parts) > 4 * CHUNK:
                parts = [merged(parts)]
                if len(parts[0][0]) > 2 * CHUNK:
                    yield out(parts.pop())
    if parts:
        yield out(merged(parts))


@dataclass
class Model:
    """probs and gammas (hi, lo, value): natural logarithms times SCALE, hi tagged by order."""

    probs: DataFrame
    gammas: DataFrame
    unseen: int
    n_rows: int


def fixed(p: Column) -> Column:
    """The logarithm of p as a whole number of 1/SCALE, at least -127."""
    return F.round(F.greatest(F.log(p), F.lit(-127.0)) * SCALE).cast("int")


def _bits(n: int) -> int:
    return (1 << BITS * max(n, 0)) - 1


def tag(order: int) -> int:
    return order << BITS * (ORDER - LOW)


def tagged(hi: Column, order: int) -> Column:
    return F.lit(tag(order)).cast("long").bitwiseOR(hi)


def _suffix(order: int) -> tuple[Column, Column]:
    """hi and lo of an n-gram's last symbols, order of them."""
    return F.col("hi").bitwiseAND(F.lit(_bits(order - LOW)).cast("long")), F.col("lo").bitwiseAND(F.lit(_bits(min(order, LOW))).cast("long"))


def _context(hi: Column, lo: Column) -> tuple[Column, Column]:
    """hi and lo of an n-gram without its last symbol."""
    moved = F.shiftleft(hi.bitwiseAND(F.lit(_bits(1)).cast("long")), BITS * (LOW - 1))
    return F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(moved)


def _named(pair: tuple[Column, Column], hi: str = "hi", lo: str = "lo") -> list[Column]:
    return [pair[0].alias(hi), pair[1].alias(lo)]


def train(docs: DataFrame) -> Model | None:
    """Counts all texts of docs (text); None where there is no text.

    Continuation counts of each lower order are counts of distinct longer n-grams; the discounts of
    an order come from its counts of counts (four numbers for each order go to the driver). A lost
    executor costs the current stage, for each order's table is written.
    """
    counted = docs.select(text_or_empty().alias("text")).mapInArrow(_count, "hi long, lo long, n long")
    tables = {ORDER: stored(counted.groupBy(KEY).agg(F.sum("n").alias("n")), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stored(tables[k + 1].groupBy(*_named(_suffix(k))).agg(F.count("*").alias("n")), f"kn-counts-{k}")
    n_symbols = tables[1].count()
    if not n_symbols:
        return None
    lower, probs, gammas = None, [], []
    for k in range(1, ORDER + 1):
        of = tables[k].agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
        d = discounts(*of)
        n = F.col("n")
        cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        context = _named(_context(F.col("hi"), F.col("lo")), "_chi", "_clo")
        sums = tables[k].groupBy(*context).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("gamma"))
        rows = tables[k].select("*", *context).join(sums, ["_chi", "_clo"])
        if lower is None:
            below = F.lit(1.0 / (n_symbols + 1))
        else:
            rows = rows.select("*", *_named(_suffix(k - 1), "_lhi", "_llo"))
            rows = rows.join(lower.select(*_named((F.col("hi"), F.col("lo")), "_lhi", "_llo"), F.col("p").alias("_p")), ["_lhi", "_llo"])
            below = F.col("_p")
        lower = stored(rows.select(*KEY, (F.greatest(n - cut, F.lit(0.0)) / F.col("total") + F.col("gamma") * below).alias("p")), f"kn-probs-{k}")
        probs.append(lower.select(tagged(F.col("hi"), k).alias("hi"), "lo", fixed(F.col("p")).alias("value")))
        gammas.append(sums.select(tagged(F.col("_chi"), k).alias("hi"), F.col("_clo").alias("lo"), fixed(F.greatest("gamma", F.lit(1e-12))).alias("value")))

    def union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    gammas = stored(union(gammas), "kn-gammas")
    probs = union(probs)
    return Model(probs, gammas, round(-math.log(n_symbols + 1) * SCALE), probs.count() + gammas.count())


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; plain fractions where a count of counts is 0."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)


class Hashed:
    """An open-addressing table from int64 keys to int32 values, built and probed by numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            tried = left[free]
            self.keys[at[free]] = keys[tried]  # of several the last stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and whether each key is present."""
        at = self._slot(keys)
        held = self.keys[at]
        values, found = self.values[at], held == keys
        left = np.flatnonzero(~found & (held != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == keys[left]
            values[left[hit]], found[left[hit]] = self.values[at[hit]], True
            more = ~hit & (held != -1)
            left, at = left[more], at[more]
        values[~found] = 0
        return values, found


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """63-bit hashes of pairs; those of pairs with one hi are distinct up to the last bit dropped."""
    x = hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x ^= lo.view(np.uint64)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(1)).view(np.int64)


def log_probs(hi: np.ndarray, lo: np.ndarray, probs: Hashed, gammas: Hashed, unseen: int) -> np.ndarray:
    """Of each n-gram's last symbol: its own order's value, else the context's weight and one order less."""
    out = np.zeros(len(hi), np.int64)
    left = np.arange(len(hi))
    for k in range(ORDER, 0, -1):
        hi, lo = hi & np.int64(_bits(k - LOW)), lo & np.int64(_bits(min(k, LOW)))
        value, found = probs.find(hashed(hi | np.int64(tag(k)), lo))
        out[left[found]] += value[found]
        left, hi, lo = left[~found], hi[~found], lo[~found]
        if not len(left):
            break
        above = (hi & np.int64(_bits(1))) << np.int64(BITS * (LOW - 1))
        out[left] += gammas.find(hashed((hi >> BITS) | np.int64(tag(k)), (lo >> BITS) | above))[0]
    out[left] += unseen
    return out


def _score_sent(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)

    def read(df: DataFrame) -> Pairs:
        t = df.select(*KEY, "value").toArrow()
        return hashed(t["hi"].to_numpy(), t["lo"].to_numpy()), t["value"].to_numpy()

    shared = spark.sparkContext.broadcast((read(model.probs), read(model.gammas), model.unseen))
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        p, g, unseen = shared.value
        tables = Hashed(*p), Hashed(*g), unseen  # built by each task, so idle workers don't hold them
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for run in chunks([t or "" for t in texts]):
                keys, lengths = pack([texts[i] or "" for i in run])
                ends = np.cumsum(lengths)
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(log_probs(*keys, *tables))])
                sums[run], n[run] = total[ends] - total[ends - lengths], lengths
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(n)], names=[*names, "_sum", "_n"])
        del tables, p, g
        trim()

    long = T.LongType()
    scored = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("_sum", long), T.StructField("_n", long)]))
    return scored.select(*names, perplexity(F.col("_sum"), F.col("_n")).alias("perplexity"))


def perplexity(total: Column, n: Column) -> Column:
    """Null for a text without characters."""
    return F.exp(-total.cast("double") / F.nullif(n, F.lit(0)) / SCALE)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts = batch.column("_row").to_numpy(), batch.column("text").to_pylist()
        for row, text in zip(rows, texts, strict=True):
            hi, lo, n = distinct(*pack([text or ""])[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row)), *map(pa.array, (hi, lo, n))], names=["_row", *KEY, "n"])


def _score_sharded(docs: DataFrame, model: Model) -> DataFrame:
    """The same perplexities by joining every document's n-gram counts with the model, order by order."""
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "kn-rows")
    left = numbered.select("_row", "text").mapInArrow(_distinct, "_row long, hi long, lo long, n long").withColumn("sum", F.lit(0).cast("long"))
    parts, at = [], ["_hi", "_lo"]
    for k in range(ORDER, 0, -1):
        hi, lo = _suffix(k)
        met = left.select("*", *_named((tagged(hi, k), lo), *at))
        met = met.join(model.probs.select(*_named((F.col("hi"), F.col("lo")), *at), F.col("value").alias("_p")), at, "left").drop(*at)
        parts.append(met.filter("_p is not null").select("_row", "n", (F.col("sum") + F.col("_p")).alias("sum")))
        above, rest = _context(hi, lo)
        left = met.filter("_p is null").drop("_p").select("*", *_named((tagged(above, k), rest), *at))
        left = left.join(model.gammas.select(*_named((F.col("hi"), F.col("lo")), *at), F.col("value").alias("_g")), at, "left")
        left = left.select("_row", *KEY, "n", (F.col("sum") + F.coalesce("_g", F.lit(0))).alias("sum"))
    parts.append(left.select("_row", "n", (F.col("sum") + model.unseen).alias("sum")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    ppl = whole.groupBy("_row").agg(perplexity(F.sum(F.col("sum") * F.col("n")), F.sum("n")).alias("perplexity"))
    return numbered.join(ppl, "_row", "left").drop("_row")


def score(docs: DataFrame, model: Model, max_sent_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """docs (with text) and perplexity, null for texts without characters.

    A model up to max_sent_bytes goes to every task as a hash table, so no text is shuffled; a larger
    one stays sharded and is joined with the documents' n-gram counts. Both give the same numbers to
    the bit.
    """
    return _score_sent(docs, model) if model.n_rows * MODEL_ROW <= max_sent_bytes else _score_sharded(docs, model)


def with_ids(docs: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    return docs.join(sent_if_small(ids, ID_ROW, n), "doc_id", how)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs with perplexity, threshold and kept added; no text moves between executors.

    Documents labelled quality 1 are trusted: a half by hash of doc_id trains the model, the other
    sets each language's threshold, the given quantile of its perplexities. A language with fewer
    than LEAST_CALIBRATION such documents, or none (null), takes the quantile over all languages.
    A document is kept up to its threshold, ties included. A text without characters (null, empty)
    has no perplexity and isn't kept. Without trusted documents, or none to calibrate on, all other
    documents stay. Labels that repeat or contradict: one label of quality 1 is enough. Columns of
    docs with the names that are added are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "kept", "cut")
    good = stored(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "kn-trusted")
    n = good.count()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = train(with_ids(docs.select("doc_id", "text"), good.filter(half), n)) if n else None
    if model is None:
        has = F.length(text_or_empty()) > 0
        return docs.withColumn("perplexity", F.lit(None).cast("double")).withColumn("threshold", F.lit(None).cast("double")).withColumn("kept", has)
    held = with_ids(docs.select("doc_id", "lang", "text"), good.filter(~half), n)
    at = stored(score(held, model).select("lang", "perplexity"), "kn-calibration")
    by = at.groupBy("lang").agg(F.count("perplexity").alias("n"), F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("cut"))
    by = stored(by.filter(f"lang is not null and n >= {LEAST_CALIBRATION}").select("lang", "cut"), "kn-thresholds")
    every = at.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))).first()[0]
    scored = score(docs, model)
    scored = scored.join(sent_if_small(by, LANG_ROW), "lang", "left")
    kept = F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(math.inf)), F.lit(False))
    threshold = F.coalesce("cut", F.lit(every).cast("double"))
    return scored.withColumn("threshold", threshold).withColumn("kept", kept).select(*docs.columns, "perplexity", "threshold", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier keeps, with their own columns, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "lang", "text")]
    rows = docs.select("doc_id", "lang", "text", F.struct(*others).alias("_rest")) if others else docs
    kept = classify(rows, labels).filter("kept")
    return kept.select(*[F.col(f"_rest.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "kept")
