"""Every stage of the pipeline against a plain version of it, each on what the stage before kept."""

import hashlib
import math
import random

import corpus_pipeline
from neurospan.llm import kneser_ney, mixing
from pyspark.sql import functions as F
from test_dedup_and_mix import targets_by_hand
from test_similarity import WORD, plain_kneser_ney, plain_set


def plain_exact(rows):
    keep = {}
    for i, t, s in rows:
        if (t or "") not in keep or i > keep[t or ""][0]:
            keep[t or ""] = (i, t, s)
    return sorted(keep.values())


def plain_near(rows):
    sets = [plain_set(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sorted(min(r for r, x in zip(rows, label) if x == k) for k in set(label))


def plain_mix(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    targets = targets_by_hand(by)
    out = []
    for s, total in by.items():
        mine = [r for r in rows if r[2] == s]
        whole = math.floor(targets[s] / total) if total else 0
        lack = targets[s] - whole * total
        c, certain = 0.0, set()
        while True:
            rest = [size[i] for i, *_ in mine if i not in certain]
            c = (lack - sum(size[i] for i in certain)) / max(sum(n * n for n in rest), 1)
            more = {i for i, *_ in mine if size[i] and c * size[i] > 1} | certain
            if more == certain:
                break
            certain = more
        pi = {i: min(1.0, c * size[i]) for i, *_ in mine}

        def odds(row):
            bits = int(hashlib.md5(f"{row[0]}:{hashlib.md5((row[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
            u = (bits + 0.5) / 2**52
            return u / (1 - u) / (pi[row[0]] / (1 - pi[row[0]]))

        before, lack = 0, lack - sum(size[i] for i in certain)
        taken = set(certain)
        for row in sorted((r for r in mine if 0 < pi[r[0]] < 1), key=odds):
            if before + size[row[0]] / 2 < lack:
                taken.add(row[0])
            before += size[row[0]]
        for row in mine:
            out += [row] * (whole + (row[0] in taken))
    return sorted(out)


def test_every_stage_equals_a_plain_version(spark, documents, tmp_path):
    rng = random.Random(31)
    words = "the river runs past old stone houses where people sell bread and talk about rain in the market every morning".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([8, 30, 60, 120])), f"s{i % 3}") for i in range(70)]
    rows += [(100 + i, rows[i][1], f"s{i % 2}") for i in range(12)]  # exact copies
    for i in range(12):  # near ones
        w = rows[30 + i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "s1"))
    rows += [(300 + i, "".join(rng.choice("XQZ#&%$!! ") for _ in range(120)), "s0") for i in range(8)] + [(400, None, "s2"), (401, "", None)]
    docs = documents([(i, t, "en", s) for i, t, s in rows])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())

    half = {r["doc_id"] for r in labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    want = plain_kneser_ney([t for i, t, _ in rows if i in half])
    calibration = sorted(want(t) for i, t, _ in rows if i < 70 and i not in half)
    limit = calibration[math.ceil(kneser_ney.QUANTILE * len(calibration)) - 1]
    docs = kneser_ney.stored(stages["quality"](spark, docs, f"file://{tmp_path}"), "test-quality")
    kept = held(docs)
    sure = lambda t: t and abs(want(t) / limit - 1) > 1e-6
    assert [r for r in kept if sure(r[1])] == sorted(r for r in rows if sure(r[1]) and want(r[1]) < limit)
    assert not any(r[0] >= 300 for r in kept) and len(kept) > 85

    docs = kneser_ney.stored(stages["exact"](spark, docs, ""), "test-exact")
    assert held(docs) == plain_exact(kept)
    kept = held(docs)
    docs = kneser_ney.stored(stages["near"](spark, docs, ""), "test-near")
    assert held(docs) == plain_near(kept) and len(held(docs)) < len(kept)
    kept = held(docs)
    docs = kneser_ney.stored(stages["mix"](spark, docs, ""), "test-mix")
    assert held(docs) == plain_mix(kept)
    kept = held(docs)
    out = stages["pack"](spark, docs, "").toPandas()
    assert out.n_words.sum() == sum(len(WORD.findall(t)) for _, t, _ in kept)
    assert out.groupby("bin_id").n_words.sum().max() <= 4096 and not out.duplicated(["bin_id", "doc_id"]).any()
    assert mixing.WEIGHTS == (1, 2, 3)
