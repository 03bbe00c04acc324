"""Suffix-array dedup: removes bytes of strings that occur more than once in the corpus.

Sorting every suffix isn't needed to find repeats of LENGTH bytes: any such string holds an anchor,
the least hash among its GRAM-byte substrings, and equal strings hold equal anchors at the same
offset. So only suffixes at anchors are ordered: by the anchor's bytes across the cluster (a hash
partitioning, the shallow part), then inside each partition by deep-shallow sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import SENT_BYTES, lean, small_batches, stored, table, text_or_empty
from neurospan.llm.filters import held, key_filter
from neurospan.llm.suffix_sort import order_and_prefixes

LENGTH = 200
GRAM = 100
SIDE = LENGTH - GRAM  # bytes that a string can have on either side of an anchor
PIECE = 1 << 20
HALO = 2 * LENGTH
#: Distinct surroundings of one anchor that are ordered in one task; strings of larger groups are counted across tasks.
MAX_GROUP = 20_000
#: Anchors of a gram from which on numpy finds their runs.
FEW = 64
#: Parts in which the places of one anchor and surrounding meet it, and bytes of such a pair in a table that is sent to every task.
SALTS, PAIR = 16, 40

_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, x in enumerate((BASE, INVERSE)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width], by doubling; shorter by width - 1."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:-rest], out[rest:]) if rest else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text index, position, hash of the gram, hash of the surroundings, their lengths left and right.

    Texts are cut into pieces with overlapping edges, so memory is bounded by a piece, and pieces
    are laid end to end up to that size.
    """
    found: list[tuple[np.ndarray, ...]] = []
    run: list[tuple[int, int, int, int, bytes]] = []  # text, offset of the piece, first and last position it answers for, bytes
    size = 0

    def flush() -> None:
        nonlocal size
        if run:
            found.append(_anchors(run))
            run.clear()
            size = 0

    for i, b in enumerate(texts):
        for a in range(0, len(b), PIECE):
            if len(b) < LENGTH:
                break
            lo, hi = max(0, a - HALO), min(len(b), a + PIECE + HALO)
            if size + hi - lo > PIECE:
                flush()
            run.append((i, lo, a - lo, min(len(b), a + PIECE) - lo, b[lo:hi]))
            size += hi - lo
    flush()
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(run: list[tuple[int, int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(x[4] for x in run), np.uint8)
    n = len(b)
    ends = np.cumsum([len(x[4]) for x in run])
    begins = ends - np.array([len(x[4]) for x in run])
    power, inverse = powers(max(n + 1, PIECE + 2 * HALO + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[b] * power[:n], out=sums[1:])
    gram = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    gram = np.minimum(gram, top - np.uint64(1))
    order = gram.copy()
    for e in ends[:-1]:  # grams and strings that would cross from one piece to the next
        order[max(0, e - GRAM + 1) : e] = top
    least = sliding(order, SIDE + 1, np.minimum)  # for the string that starts here
    for e in ends[:-1]:
        least[max(0, e - LENGTH + 1) : e] = 0
    # an anchor is the least of one string at least; strings that hold it start up to SIDE before
    most = sliding(np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)]), SIDE + 1, np.maximum)
    at = np.flatnonzero(most[: len(order)] == order)
    piece = np.searchsorted(ends, at, "right")
    local = at - begins[piece]
    own = (local >= np.array([x[2] for x in run])[piece]) & (local < np.array([x[3] for x in run])[piece])
    at, piece, local = at[own], piece[own], local[own]
    left = np.minimum(at - begins[piece], SIDE)
    right = np.minimum(ends[piece] - at - GRAM, SIDE)
    around = (sums[at + GRAM + right] - sums[at - left]) * inverse[at - left]
    around = mixed(around ^ mixed((left * 1000 + right + 1).astype(np.uint64)))
    text = np.array([x[0] for x in run])[piece]
    position = local + np.array([x[1] for x in run])[piece]
    return text, position, gram[at].view(np.int64), around.view(np.int64), left, right


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in runs of bounded size, with the index of the first."""
    lean()
    column, start, run, size = batch.column("text"), 0, [], 0
    for i, x in enumerate(column):
        b = x.as_py() or b""
        if run and size + len(b) > 8 * PIECE:
            yield start, run
            start, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield start, run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _runs(batch):
            _, _, gram, around, _, _ = anchors(texts)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around)], names=["gram", "around"])


PLACES = "k1 long, k2 long, at int, gram long, around long, l short, r short, context binary"


def _places(seen: np.ndarray, uneven: np.ndarray):
    """Anchors whose gram may repeat; the bytes around them only where these may differ."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, differ = seen.value, uneven.value
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for start, texts in _runs(batch):
                text, at, gram, around, left, right = anchors(texts)
                keep = held(repeats, gram)
                text, at, gram, around, left, right = (x[keep] for x in (text, at, gram, around, left, right))
                wanted = np.zeros(len(gram), bool)
                wanted[held(differ, gram)] = True
                context = [
                    texts[t][p - a : p] + texts[t][p + GRAM : p + GRAM + z] if w else None
                    for t, p, a, z, w in zip(text.tolist(), at.tolist(), left.tolist(), right.tolist(), wanted.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[start + text]), pa.array(k2[start + text]), pa.array(at.astype(np.int32)), pa.array(gram), pa.array(around), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), pa.array(context, pa.binary())],
                    names=["k1", "k2", "at", "gram", "around", "l", "r", "context"],
                )
    return find


def shared_extent(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int] | None]:
    """For each anchor of a gram: bytes around it, from and to, inside strings that another shares.

    A string with o bytes on the left needs o of one side and SIDE - o of the other. In the order of
    the right sides those that share SIDE - o bytes are runs, cut where neighbours share less, and so
    are those that share o bytes in the order of the left sides read backwards. Two anchors share the
    string if they are in one run of both.
    """
    n = len(rights)
    right_order, right_shared = order_and_prefixes(rights)
    left_order, left_shared = order_and_prefixes([x[::-1] for x in lefts])
    most_right, most_left = [0] * n, [0] * n
    for order, shared, most in ((right_order, right_shared, most_right), (left_order, left_shared, most_left)):
        for k in range(1, n):
            for i in (order[k - 1], order[k]):
                most[i] = max(most[i], shared[k])
    spans = [(max(0, SIDE - r), min(SIDE, a)) for a, r in zip(most_left, most_right, strict=True)]
    if n == 2:
        (lo, hi), _ = spans
        return [(-hi, LENGTH - lo)] * 2 if lo <= hi else [None] * n
    least, most = [SIDE + 1] * n, [-1] * n
    if n > FEW:
        return _runs_of_many(np.array(right_order), np.array(right_shared), np.array(left_order), np.array(left_shared))
    first, last = min(lo for lo, _ in spans), max(hi for _, hi in spans)
    for o in range(first, last + 1):
        run, runs = 0, [0] * n
        for i, shared in zip(right_order, right_shared, strict=True):
            run += shared < SIDE - o
            runs[i] = run
        run, seen = 0, {}
        for i, shared in zip(left_order, left_shared, strict=True):
            run += shared < o
            seen.setdefault((run, runs[i]), []).append(i)
        for together in seen.values():
            if len(together) > 1:
                for i in together:
                    least[i], most[i] = min(least[i], o), o
    return [(-b, LENGTH - a) if b >= 0 else None for a, b in zip(least, most, strict=True)]


def _runs_of_many(right_order: np.ndarray, right_shared: np.ndarray, left_order: np.ndarray, left_shared: np.ndarray) -> list[tuple[int, int] | None]:
    """shared_extent's runs for many anchors, by numpy."""
    n = len(right_order)
    least, most = np.full(n, SIDE + 1), np.full(n, -1)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SIDE + 1):
        right[right_order] = np.cumsum(right_shared < SIDE - o)
        left[left_order] = np.cumsum(left_shared < o)
        _, which, count = np.unique(right * (n + 1) + left, return_inverse=True, return_counts=True)
        hit = count[which] > 1
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    return [(-int(b), LENGTH - int(a)) if b >= 0 else None for a, b in zip(least, most, strict=True)]


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram; a gram's rows can span batches."""
    gram, rows = None, []

    def close() -> list[tuple[int, int, int, int, int]]:
        if len(rows) < 2:
            return []
        found = shared_extent([c[:a] for *_, a, c in rows], [c[a:] for *_, a, c in rows])
        return [(k1, k2, at, at + x[0], at + x[1]) for (n, k1, k2, at, _, _), x in zip(rows, found, strict=True) if x and n == 1]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        k1, k2, _, lo, hi = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["k1", "k2", "lo", "hi"])

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("gram", "n", "k1", "k2", "at", "l", "context")]
        for g, *row in zip(*columns, strict=True):
            if g != gram:
                out += close()
                gram, rows = g, []
            rows.append(row)
        if out:
            yield batch_of(out)
    if out := close():
        yield batch_of(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, sha = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            b, spans = text.as_py() or b"", spans.as_py() or []
            kept, end, gone, n = [], 0, 0, 0
            start = stop = None
            for s in sorted((x["lo"], x["hi"]) for x in spans) + [(len(b) + 1, len(b) + 1)]:
                if stop is not None and s[0] <= stop:
                    stop = max(stop, s[1])
                    continue
                if stop is not None:
                    kept.append(b[end:start])
                    end, gone, n = stop, gone + stop - start, n + 1
                start, stop = s
            kept.append(b[end:])
            size.append(len(b)), removed.append(gone), runs.append(n)
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def met_again(places: DataFrame, again: DataFrame) -> DataFrame:
    """The places whose gram and surroundings are in again; where that is sent to no task, in SALTS parts of each pair."""
    n = again.count()
    if n * PAIR <= SENT_BYTES:
        return places.join(F.broadcast(again), ["gram", "around"], "left_semi")
    salt = F.pmod(F.xxhash64("k1", "k2", "at"), F.lit(SALTS)).cast("int")
    dealt = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("_salt", salt).join(dealt, ["gram", "around", "_salt"], "left_semi").drop("_salt")


def spread_extent(rows: DataFrame) -> DataFrame:
    """k1, k2, lo, hi of what shared_extent finds, for groups too large for one task.

    Each string around an anchor is a row, known by a hash of gram, offset and bytes, and strings met
    twice are found by partial counts; no task sees a group.
    """
    right = F.length("context") - F.col("l")
    first, last = F.greatest(F.lit(0), F.lit(SIDE) - right), F.least(F.lit(SIDE), F.col("l").cast("int"))
    offset = rows.filter(first <= last).withColumn("o", F.explode(F.sequence(first, last)))
    strings = offset.select("k1", "k2", "at", "n", "o", F.xxhash64("gram", "o", F.substring("context", F.col("l") - F.col("o") + 1, F.lit(SIDE))).alias("string"))
    met = strings.groupBy("string").count().filter("count > 1").select("string")
    found = strings.filter("n = 1").join(met, "string", "left_semi").groupBy("k1", "k2", "at").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    return found.select("k1", "k2", (F.col("at") - F.col("most")).cast("int").alias("lo"), (F.col("at") + LENGTH - F.col("least")).cast("int").alias("hi"))


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """k1, k2, lo, hi: byte spans, by the key of their text, covered by strings that start elsewhere too.

    First all grams at anchors are counted with the least and greatest hash of their surroundings.
    A gram met twice with equal surroundings throughout is settled: all strings around it repeat.
    The other grams' distinct surroundings, a row each however often they occur, are ordered by
    deep-shallow sorting, a gram to a task, or counted string by string where a gram has more than
    max_group of them; both give the same spans. A filter keeps most other anchors out of the second pass; the
    join with the repeated grams is what decides, whatever it lets through.
    """
    rows = docs.select("text")
    counted = rows.mapInArrow(_grams, "gram long, around long").groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
    repeated = stored(counted.filter("n > 1").select("gram", (F.col("a") < F.col("b")).alias("differ")), "repeat-grams")
    seen, uneven = key_filter(repeated.select("gram")), key_filter(repeated.filter("differ").select("gram"))
    places = docs.select("k1", "k2", "text").mapInArrow(_places(seen, uneven), PLACES)
    places = stored(places.join(repeated, "gram"), "repeat-places")
    whole = F.col("l") + F.col("r") >= SIDE
    full = [F.col("k1"), F.col("k2"), (F.col("at") - F.col("l")).cast("int").alias("lo"), (F.col("at") + GRAM + F.col("r")).cast("int").alias("hi")]
    same = places.filter(~F.col("differ") & whole).select(*full)
    differ = places.filter("differ")
    groups = differ.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"), F.first("l").alias("l"), F.first("context").alias("context")
    ).select("gram", "around", "n", "one.k1", "one.k2", "one.at", "l", "context")
    groups = stored(groups, "repeat-groups")
    copies = met_again(differ.filter(whole), groups.filter("n > 1").select("gram", "around")).select(*full)
    large = stored(groups.groupBy("gram").count().filter(F.col("count") > max_group).select("gram"), "repeat-large")
    sorted_ = groups.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "around").select("gram", "n", "k1", "k2", "at", "l", "context")
    deep = sorted_.mapInArrow(_deep, "k1 long, k2 long, lo int, hi int")
    found = same.unionByName(copies).unionByName(deep)
    if large.limit(1).count() == 0:
        return found
    return found.unionByName(spread_extent(groups.join(large, "gram", "left_semi")))


def remove_repeats(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. Texts shorter than LENGTH lose nothing. A document
    is known by its id and text, so repeated rows are separate places of the same text and both lose
    what they share; null ids are allowed. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = text_or_empty()
    keyed = docs.select("doc_id", F.xxhash64(text, F.col("doc_id")).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.cast("binary").alias("text"))
    spans = repeated_spans(keyed.filter(F.octet_length("text") >= LENGTH), max_group).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_deep_shallow(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
