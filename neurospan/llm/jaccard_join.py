"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, and links are short distances. Regions start as the sets that
share one of their first tokens (two sets that link share one, in any order common to all sets).
Level by level every region elects pivots among its own sets, so pivots are in proportion to the
data. Sets within REACH of a pivot form its Voronoi cell, sets that a member of the cell could still
reach by the triangle inequality are replicated to the cell, and what is in no cell goes on as the
far part. Cells and far parts are regions of the next level, down to leaves of LEAF sets, which are
joined exactly in one task each; below the first level a region that is larger, as nothing in it lies within reach
of its pivots, is dealt to groups, and each pair of groups is a leaf. Sets that are linked already, such as all members of a cell, are
never compared at any level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm.common import lean, sent_if_small, stored, table, text_or_empty, trim
from neurospan.llm.components import components
from neurospan.llm.filters import held, key_filter
from neurospan.llm.shingles import runs, set_hash, shingle_sets

#: Percent of the union that two linked sets share at least, and the distance that allows.
PERCENT = 80
REACH = 1 - PERCENT / 100
#: Percent that a set shares at least with the pivot of a cell, some member of which it could link with.
WINDOW = 100 - 2 * (100 - PERCENT)
#: A region elects one pivot at the first level and this many times as many at each further one.
GROWTH = 16
#: Sets of a region that one task joins, and how many of them meet the others at a time.
LEAF, BLOCK = 2048, 256
#: Groups of half a LEAF to which a larger region is dealt at most; two groups at a time are a leaf.
GROUPS = 64
#: Sets of a region that are joined without a task of their own.
FEW = 16
#: Bytes of a row of regions or pairs in a table that is sent to every task.
ROW = 64
SLOTS = 1 << 22
PARTS = 64


def prefix_size(n: np.ndarray | int):
    """Tokens of a set of n that can hold its first shared one: n - ceil(n * PERCENT / 100) + 1."""
    return n - (n * PERCENT + 99) // 100 + 1


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts = [x.as_py() or b"" for x in batch.column("text")]
    for start, run in runs(texts):
        yield start, shingle_sets(run)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and a task's token counts in SLOTS slots (up to 255) as rows of their own."""
    lean()
    counts, waiting, n_waiting = np.zeros(SLOTS, np.uint8), [], 0

    def fold() -> None:
        more = np.bincount(np.concatenate(waiting), minlength=SLOTS)
        more += counts
        np.minimum(more, 255, out=more)
        counts[:] = more
        waiting.clear()

    names = ["doc_id", "h", "n", "c", "part", "counts"]
    for batch in batches:
        n, c = [], []
        for _, sets in _sets_of(batch):
            n += [len(s) for s in sets]
            c += [set_hash(s) for s in sets]
            for s in sets:
                waiting.append((s & np.uint64(SLOTS - 1)).astype(np.int64))
                n_waiting += len(s)
            if n_waiting > SLOTS // 4:
                fold()
                n_waiting = 0
        rows = len(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if waiting:
        fold()
    if counts.any():
        parts = counts.reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 4, pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=names)
    trim()


def _add_counts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(x, np.uint8).astype(np.uint32) for x in frame["counts"]), np.zeros(SLOTS // PARTS, np.uint32))
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def token_levels(rows: DataFrame) -> np.ndarray:
    """How often each slot's tokens are met, scaled to a mean of 1,000.

    The table has SLOTS numbers whatever the corpus. It only orders tokens, rare ones first: any
    order gives the same links. A token stands out where its count passes the spread of a slot's
    load, so the share of the corpus from which tokens stand out falls as the corpus grows.
    """
    parts = rows.filter("part is not null").select("part", "counts").repartition(PARTS // 4, "part")
    total = np.zeros(SLOTS, np.float32)
    for r in parts.groupBy("part").applyInPandas(_add_counts, "part int, counts binary").collect():
        total[r["part"] * (SLOTS // PARTS) : (r["part"] + 1) * (SLOTS // PARTS)] = np.frombuffer(r["counts"], np.uint32)
    return np.minimum(total * (1000 / max(total.mean(), 1e-6)), 65_535).astype(np.uint16)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit for each slot of a hash: whether an odd number of tokens fell there.

    Two sketches of one size differ in at most as many bits as their sets differ in tokens, so the
    bits bound the size of the symmetric difference from below. There are two slots a token or more;
    the halves of a sketch, combined by exclusive or, are the sketch of half the size.
    """
    bits = 256
    while bits < 2 * len(tokens):
        bits *= 2
    slots = ((tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _first(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The tokens of a set that can hold its first shared one, rare ones first."""
    level = levels[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
    return tokens[np.argsort(level, kind="stable")[: prefix_size(len(tokens))]].view(np.int64)


def _keys(shared):
    """(key, c, n) for each first token of each text's set of n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for _, sets in _sets_of(batch):
                firsts = [_first(s, shared.value) for s in sets]
                keys = np.concatenate([*firsts, np.empty(0, np.int64)])
                count = [len(x) for x in firsts]
                c, n = np.repeat(np.array([set_hash(s) for s in sets], np.int64), count), np.repeat(np.array([len(s) for s in sets], np.int32), count)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c), pa.array(n)], names=["key", "c", "n"])
        trim()
    return run


SETS = "c long, n int, keys array<struct<key: long, at: int>>, sketch array<long>"


def _met_sets(shared, seen):
    """The sets some first token of which may have met another set, with those tokens; a task tells each set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        levels, filter_ = shared.value, seen.value
        told: set[int] = set()
        for batch in batches:
            for _, sets in _sets_of(batch):
                cs, ns, sketches = [], [], []
                counts, keys, ats = [], [], []
                for s in sets:
                    c = set_hash(s)
                    if not len(s) or c in told:
                        continue
                    told.add(c)
                    key = _first(s, levels)
                    at = held(filter_, key)
                    if not len(at):
                        continue
                    cs.append(c)
                    ns.append(len(s))
                    counts.append(len(at))
                    keys.append(key[at])
                    ats.append(at.astype(np.int32))
                    sketches.append(parity_sketch(s))
                if counts:
                    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ats))], names=["key", "at"])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ns, pa.int32()), lists, pa.array(sketches, pa.list_(pa.int64()))], names=["c", "n", "keys", "sketch"])
        trim()
    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, tokens: a task tells each set once."""
    lean()
    told: set[int] = set()
    for batch in batches:
        for _, sets in _sets_of(batch):
            new = []
            for s in sets:
                c = set_hash(s)
                if c not in told:
                    told.add(c)
                    new.append((c, s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in new], pa.int64()), pa.array([t for _, t in new], pa.list_(pa.int64()))], names=["c", "tokens"])


class Sets:
    """Sketches of the sets that may have a partner, and tokens of those that were close to one, read when they are wanted."""

    def __init__(self, docs: DataFrame, classes: DataFrame, sketches: DataFrame) -> None:
        self.docs, self.classes, self.sketches = docs, classes, sketches
        self.tokens: DataFrame | None = None

    def fetch(self, close: DataFrame, n: int) -> None:
        """Reads the tokens of the sets in close (a, b), n pairs, that aren't there yet: of one document each."""
        wanted = close.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        if self.tokens is not None:
            wanted = wanted.join(self.tokens.select("c"), "c", "left_anti")
        wanted = stored(wanted, "join-wanted")
        m = wanted.count()
        if not m:
            return
        reps = self.classes.join(sent_if_small(wanted, ROW, m), "c").groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("r"))
        reps = stored(reps.select("r.*"), "join-readers")
        read = self.docs.join(sent_if_small(reps, ROW, m), ["doc_id", "h"], "left_semi").select("text").mapInArrow(_tokens, "c long, tokens array<long>")
        read = stored(read, "join-tokens")
        if read.count() > m:  # rows that repeat id and text, read by several tasks
            read = stored(read.dropDuplicates(["c"]), "join-tokens")
        self.tokens = read if self.tokens is None else self.tokens.unionByName(read)

    def sides(self, table: DataFrame, of: DataFrame, n: int, column: str) -> DataFrame:
        """The n pairs (a, b) with the column of both; each side is met on its own, so only pairs with what they need move."""
        one = lambda x: table.select(F.col("c").alias(x), F.col(column).alias(f"{column}_{x}")).join(sent_if_small(of, ROW, n), x)
        return one("a").join(one("b"), ["a", "b"])

    def close(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The stored pairs (a, b) that may share percent of their union: parity sketches, a few words a set, rule out nearly all others."""
        def folded(x: Column, size: Column) -> Column:
            half = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda a, b: a.bitwiseXOR(b))
            return F.when(F.size(x) > size, half).otherwise(x)

        n = pairs.count()
        sketched = self.sides(self.sketches.withColumn("sized", F.struct("n", "sketch")), pairs, n, "sized")
        x, y = F.col("sized_a.sketch"), F.col("sized_b.sketch")
        size = F.least(F.size(x), F.size(y))  # one is at most twice the other, as the sets' sizes are
        differ = F.aggregate(F.zip_with(folded(x, size), folded(y, size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        most = (100 - percent) * (F.col("sized_a.n") + F.col("sized_b.n"))  # (100 + percent) times the greatest difference
        return stored(sketched.filter((100 + percent) * differ <= most).select("a", "b"), "join-close")

    def distances(self, close: DataFrame, percent: int) -> DataFrame:
        """a, b, d, link for the stored pairs (a, b) of sets that share percent of their union or more, by intersecting them."""
        n = close.count()
        if n:
            self.fetch(close, n)
        if not n or self.tokens is None:
            return close.select("a", "b", F.lit(0.0).alias("d"), F.lit(False).alias("link")).limit(0)
        both = self.sides(self.tokens, close, n, "tokens")
        both = both.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"), (F.size("tokens_a") + F.size("tokens_b")).alias("sum"))
        union = F.col("sum") - F.col("both")
        inside = both.filter(100 * F.col("both") >= percent * union)
        return inside.select("a", "b", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= PERCENT * union).alias("link"))


class Labels:
    """c, label: the component so far of each set that has a link; other sets are their own."""

    def __init__(self, spark: SparkSession) -> None:
        self.table, self.n = spark.createDataFrame([], "c long, label long"), 0

    def of(self, c: str, label: str) -> DataFrame:
        return sent_if_small(self.table.select(F.col("c").alias(c), F.col("label").alias(label)), ROW, self.n)

    def merge(self, links: DataFrame) -> None:
        """Labels that links (a, b) join become one, the least."""
        ends = links.join(self.of("a", "la"), "a", "left").join(self.of("b", "lb"), "b", "left")
        edges = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        found = components(edges)
        n = found.count()
        merged = sent_if_small(found.select(F.col("v").alias("label"), F.col("label").alias("to")), ROW, n)
        moved = self.table.join(merged, "label", "left").select("c", F.coalesce("to", "label").alias("label"))
        fresh = found.select(F.col("v").alias("c"), "label").join(self.of("c", "_old"), "c", "left_anti")
        self.table = stored(moved.unionByName(fresh), "join-labels")
        self.n = self.table.count()


def opened(rows: DataFrame, labels: Labels) -> DataFrame:
    """The rows of regions that may still hold a link between two labels, with label, held, top, free and first.

    held is the number of sets of the region, top is the region's most frequent label and free the number of sets outside it: pivots come from
    those, so a group that is linked already is never compared with itself. first is the set that
    comes first by at or away.
    """
    tagged = rows.join(labels.of("c", "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    order = F.struct(F.coalesce(F.col("at").cast("double"), "away"), "c")
    blocks = tagged.groupBy("region", "label").agg(F.count("*").alias("k"), F.max("home").alias("home"), F.min(order).alias("first"))
    of = blocks.groupBy("region").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("label", "k").alias("top"), F.max("home").alias("some_home"), F.min("first").alias("first"))
    of = of.filter("n > most and some_home").select("region", F.col("n").alias("held"), "top", (F.col("n") - F.col("most")).alias("free"), F.col("first.c").alias("first"))
    return tagged.join(of, "region")


def elected(rows: DataFrame, level: int) -> DataFrame:
    """The pivots of each region: its first set, and at level k about GROWTH ** k of its free sets, all where there are fewer.

    A set whose first tokens other sets share stands in the middle of them: changes give a text
    tokens of its own, and those come before. So the first set of a region, in whose order the
    region's token comes earliest, is the centre of many; in a cell it is the nearest to the centre.
    The others are drawn by a lot that is the same in every region, so that the pivots of overlapping
    regions are few.
    """
    lot = F.pmod(F.xxhash64("c", F.lit(level)), F.lit(1 << 20))
    drawn = (F.col("label") != F.col("top")) & (lot * F.col("free") < F.lit((GROWTH**level << 20) if level else 0))
    return rows.filter((F.col("c") == F.col("first")) | drawn)


def compared(rows: DataFrame, pivots: DataFrame, n: int, percent: int) -> DataFrame:
    """region, p, y, a, b, n: the pivots and the sets (n rows) of their regions that could share percent of their union.

    For links (PERCENT) only sets of different labels count. Sizes bound what is shared, and so do
    the tokens after the one that made the region and, as the first that a pair shares may be taken,
    those before it. In a cell, whose sets know their distance to its centre, those distances differ
    by REACH at most, and one of the two is a member. For the windows of cells (WINDOW) any set
    counts, and the shared token need not be the first one.
    """
    p = pivots.select("region", F.col("c").alias("p"), F.col("n").alias("np"), F.col("at").alias("ip"), F.col("home").alias("hp"), F.col("away").alias("dp"), F.col("label").alias("lp"))
    y = rows.select("region", F.col("c").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("home").alias("hy"), F.col("away").alias("dy"), F.col("label").alias("ly"))
    whole, need = F.lit(100 + percent), percent * (F.col("np") + F.col("ny"))
    after_p, after_y = F.col("np") - F.coalesce("ip", F.lit(0)), F.col("ny") - F.coalesce("iy", F.lit(0))
    before = F.coalesce(F.least("ip", "iy"), F.lit(0))
    bound = (100 * F.least("np", "ny") >= percent * F.greatest("np", "ny")) & (whole * (before + F.least(after_p, after_y)) >= need)
    if percent == PERCENT:
        in_ring = (F.col("hp") | F.col("hy")) & (F.abs(F.col("dp") - F.col("dy")) <= REACH + 1e-9)
        bound = bound & (F.col("lp") != F.col("ly")) & (whole * after_p >= need) & (whole * after_y >= need) & (F.col("dp").isNull() | in_ring)
    met = y.alias("y").join(sent_if_small(p, ROW, n).alias("p"), (F.col("p.region") == F.col("y.region")) & bound)
    return met.select("p.region", "p", "y", F.least("p", "y").alias("a"), F.greatest("p", "y").alias("b"), F.col("ny").alias("n"))


def cells(left: DataFrame, n: int, pivots: DataFrame, links: DataFrame | None, sets: Sets, level: int) -> DataFrame:
    """The regions below those of left (n rows), whose pivots are gone: cells with their windows, and far parts.

    The pivots that found a link get cells: a set within REACH of some is a member (home) of the cell
    of the nearest and leaves the far part, and a set within 2 * REACH of a pivot is in its cell, so
    whatever links with a member is there. The cells that one pivot has in several regions are one
    region. Cells among left stay as they are, without their pivots.
    """
    names = ["region", "c", "n", "at", "home", "away"]
    if links is None:
        return left.select(names)
    linked = links.select(F.explode(F.array("a", "b")).alias("c"))
    cored = pivots.filter("away is null").join(sent_if_small(linked, ROW, 2 * links.count()), "c", "left_semi")
    met = stored(compared(left, cored, n, WINDOW), "join-window")
    pairs = stored(met.select("a", "b").distinct(), "join-pairs")
    near = stored(sets.distances(sets.close(pairs, WINDOW), WINDOW), "join-near")
    k = near.count()
    if not k:
        return left.select(names)
    inside = stored(met.join(sent_if_small(near, ROW, k), ["a", "b"]).select("region", "p", F.col("y").alias("c"), "n", "d", "link"), "join-inside")
    k = inside.count()
    nearest = sent_if_small(inside.filter("link").groupBy("region", "c").agg(F.min_by("p", F.struct("d", "p")).alias("nearest")), ROW, k)
    far = left.select(names).join(nearest, ["region", "c"], "left_anti")
    found = inside.join(nearest, ["region", "c"], "left").groupBy("p", "c", "n").agg(F.max(F.coalesce(F.col("p") == F.col("nearest"), F.lit(False))).alias("home"), F.min("d").alias("away"))
    found = found.select(F.xxhash64("p", F.lit(level), F.lit("cell")).alias("region"), "c", "n", F.lit(None).cast("int").alias("at"), "home", "away")
    return far.unionByName(found)


def _differ(sketches: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of p and q, pair by pair, differ; a sketch of twice the size is folded."""
    sizes = np.array([len(x) for x in sketches])
    place = np.zeros(len(sketches), np.int64)
    whole, half = {}, {}
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        place[of] = np.arange(len(of))
        whole[size] = np.stack([sketches[i] for i in of])
        half[size] = whole[size][:, : size // 2] ^ whole[size][:, size // 2 :]
    out = np.zeros(len(p), np.int64)
    kind = sizes[p] << 32 | sizes[q]
    for k in np.unique(kind).tolist():
        x, y = k >> 32, k & 0xFFFFFFFF
        a, b = (half if x > y else whole)[x], (half if y > x else whole)[y]
        at, step = np.flatnonzero(kind == k), max(1, (1 << 18) // min(x, y))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            out[some] = np.bitwise_count(a[place[p[some]]] ^ b[place[q[some]]]).sum(1)
    return out


def _leaf(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one leaf with different labels that may link, by the bounds of compared and by their sketches.

    Of a leaf of two groups only pairs across them count: each group is a leaf of its own too.
    """
    c, n, label, group = (frame[x].to_numpy(np.int64) for x in ("c", "n", "label", "group"))
    two = len(group) > 0 and bool((group != group[0]).any())
    at, away, home = frame["at"].fillna(0).to_numpy(np.int64), frame["away"].to_numpy(float), frame["home"].to_numpy(bool)
    after = n - at
    sketches = [np.asarray(x, np.int64).view(np.uint64) for x in frame["sketch"]]  # bits of signed numbers would be those of their size
    found = []
    for start in range(0, len(c), BLOCK):
        i, j = np.nonzero(label[start : start + BLOCK, None] != label[None, start + 1 :])
        i, j = i + start, j + start + 1
        for bound in (
            lambda i, j: (i < j) & ((group[i] != group[j]) | (not two)),
            lambda i, j: 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]),
            lambda i, j: (100 + PERCENT) * np.minimum(after[i], after[j]) >= PERCENT * (n[i] + n[j]),
            lambda i, j: np.isnan(away[i]) | ((home[i] | home[j]) & (np.abs(away[i] - away[j]) <= REACH + 1e-9)),
            lambda i, j: (100 + PERCENT) * _differ(sketches, i, j) <= (100 - PERCENT) * (n[i] + n[j]),
        ):
            keep = bound(i, j)
            i, j = i[keep], j[keep]
        found.append((np.minimum(c[i], c[j]), np.maximum(c[i], c[j])))
    return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def leaf_pairs(leaves: DataFrame, sets: Sets) -> DataFrame:
    """The pairs (a, b) that may link of stored regions; a region of LEAF sets or fewer is one task's.

    A larger one is dealt to groups of half a LEAF by hash, and each pair of its groups is a task's: comparisons
    stay in tasks, sketch against sketch, and only pairs that pass leave them.
    """
    groups = F.when(F.col("held") > LEAF, F.ceil(F.col("held") / max(LEAF // 2, 1))).otherwise(1).cast("int")
    dealt = leaves.withColumn("group", F.pmod(F.xxhash64("c", F.lit("group")), groups).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
    dealt = dealt.withColumn("tile", F.least("group", "other") * GROUPS * 2 + F.greatest("group", "other")).drop("other", "held", "top", "free", "first")
    n = leaves.agg(F.sum(groups)).first()[0] or 0
    rows = sets.sketches.select("c", "sketch").join(sent_if_small(dealt, 2 * ROW, n), "c")
    return stored(rows.groupBy("region", "tile").applyInPandas(_leaf, "a long, b long").distinct(), "join-leaves")


def class_labels(docs: DataFrame, classes: DataFrame, counts: DataFrame) -> Labels:
    """The sets that link with another one, by component; docs (doc_id, h, text) and classes (doc_id, h, c) are those with an id.

    A level compares the pivots of every region with its sets. Pivots are done with then, as they were
    compared with all that they could link with. Of the regions that still hold two labels those of a
    FEW sets are joined whole, the small ones are leaves, and the others are cut into cells and far parts. After two levels
    regions of up to GROUPS / 2 leaves are dealt to leaves as they are: where members lie just beyond reach of each other,
    more pivots would only write down more pairs.
    """
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(token_levels(counts))
    text = docs.select("text")
    counted = text.mapInArrow(_keys(levels), "key long, c long, n int").groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("n").alias("least"))
    met = stored(counted.filter("a < b").select("key", "least"), "join-keys")
    sketched = stored(text.mapInArrow(_met_sets(levels, key_filter(met.select("key"))), SETS).dropDuplicates(["c"]), "join-sets")
    sets, labels = Sets(docs, classes, sketched.select("c", "n", "sketch")), Labels(spark)
    first = sketched.select("c", "n", F.explode("keys").alias("_k")).select(F.col("_k.key").alias("region"), "c", "n", F.col("_k.at").alias("at"))
    # a pair's first shared token leaves room for the rest of what even the smallest partner must share
    room = (100 + PERCENT) * (F.col("n") - F.col("at")) >= PERCENT * (F.col("n") + F.col("least"))
    first = first.join(met.withColumnRenamed("key", "region"), "region").filter(room)
    regions = first.select("region", "c", "n", "at", F.lit(True).alias("home"), F.lit(None).cast("double").alias("away"))

    def linked(pairs: DataFrame, bounded: bool = False) -> DataFrame | None:
        links = stored(sets.distances(pairs if bounded else sets.close(pairs, PERCENT), PERCENT), "join-links").filter("link").select("a", "b")
        if links.isEmpty():
            return None
        labels.merge(links)
        return links

    level = 0
    while True:
        rows = stored(opened(regions, labels), "join-rows")
        n = rows.count()
        if not n:
            return labels
        pivots = elected(rows, level)
        links = linked(stored(compared(rows, pivots, n, PERCENT).select("a", "b").distinct(), "join-pairs"))
        left = rows.drop("label", "held", "top", "free", "first").join(sent_if_small(pivots.select("region", "c"), ROW, n), ["region", "c"], "left_anti")
        left = stored(opened(left, labels), "join-left")
        dealt = max(LEAF, GROUPS * LEAF // 2) if level else LEAF
        few, leaves, large = left.filter(F.col("held") <= FEW), left.filter(f"held > {FEW} and held <= {dealt}"), left.filter(F.col("held") > max(FEW, dealt))
        n = few.count()
        if n:
            linked(stored(compared(few, few, n, PERCENT).select("a", "b").distinct(), "join-few"))
        if not leaves.isEmpty():
            linked(leaf_pairs(leaves, sets), True)
        n = large.count()
        if not n:
            return labels
        regions = cells(large, n, pivots, links, sets, level)
        level += 1


def judged_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, c) of every row, h a hash of its text, and (c, label, v) of every set that has an id, v its least."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().cast("binary").alias("text"))
    rows = stored(docs.mapInArrow(_classes, "doc_id long, h long, n long, c long, part int, counts binary"), "join-classes")
    sets = rows.filter("part is null").select("doc_id", "h", "n", "c")
    known = sets.filter("n > 0 and doc_id is not null")
    labels = class_labels(docs.filter("doc_id is not null"), known, rows)
    named = known.groupBy("c").agg(F.min("doc_id").alias("v"))
    return sets, stored(named.join(labels.of("c", "label"), "c", "left").select("c", F.coalesce("label", "c").alias("label"), "v"), "join-named")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when their sets of five-word shingles (A-Z lower-cased, whole text) share 80
    percent of their union or more; component_id is the smallest doc_id reachable. Equal sets are
    one class and meet the others once, however many copies there are. Only links that join two
    components are looked for, so links are not counted. A null or empty text, or one without
    words, has an empty set, which links with nothing. Rows that repeat a doc_id are one document of
    the graph: all its texts link for it, and all its rows have its component. A null doc_id is no
    document: it joins nothing, and its component is that of its set, or null where no document has
    the set. Other columns are ignored. Shingles and sets are known by 64 bits.
    """
    sets, named = judged_sets(docs)
    least = stored(named.join(named.groupBy("label").agg(F.min("v").alias("a")), "label").select("c", "a"), "join-least")
    # a document id that stands for several sets joins their components
    repeated = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("_x"), F.max("c").alias("_y")).filter("_x < _y").select("doc_id")
    own = stored(sets.filter("n > 0").join(repeated, "doc_id").select("doc_id", "c").distinct().join(least, "c").select("doc_id", F.col("a").alias("b")).distinct(), "join-repeated")
    by_set = least.select("c", F.col("a").alias("by_set"))
    if not own.isEmpty():
        edges = own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b")
        labels = components(edges).withColumnRenamed("v", "a")
        by_set = least.join(labels, "a", "left").select("c", F.coalesce("label", "a").alias("by_set"))
    out = sets.join(by_set, "c", "left").withColumn("by_set", F.when(F.col("n") > 0, F.col("by_set")))
    by_id = out.filter("doc_id is not null and by_set is not null").groupBy("doc_id").agg(F.min("by_set").alias("by_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_id", "doc_id")).otherwise(F.col("by_set"))
    return out.join(by_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of linked sets: the row with the smallest doc_id.

    A row is judged by its own text, whatever other rows repeat its doc_id; of rows with one doc_id
    and different linked texts the one with the least set hash stays, and rows equal in doc_id and
    text stay or go together. Empty texts stay. A null doc_id goes where its set has another id.
    """
    sets, named = judged_sets(docs)
    stays = named.groupBy("label").agg(F.min(F.struct("v", "c")).alias("stays"))
    rows = sets.filter("n > 0").join(named.select("c", "label"), "c").join(stays, "label")
    goes = ~F.coalesce((F.col("doc_id") == F.col("stays.v")) & (F.col("c") == F.col("stays.c")), F.lit(False))
    gone = stored(rows.filter(goes).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "join-gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(text_or_empty()) == gone["_h"])
    return docs.join(sent_if_small(gone, 40), same, "left_anti")


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
