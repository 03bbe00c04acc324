import collections
import hashlib
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from neurospan.llm import jaccard_join, kneser_ney, repeats, shingles
from neurospan.llm.components import components
from neurospan.llm.suffix_sort import common_prefix, deep_shallow_order, neighbour_prefixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    """(n_shingles, component) of every row; rows that repeat an id are one document."""
    sets = [plain_set(t) for _, t in rows]
    label = {i: i for i, _ in rows}
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return [(i, len(s), label[i]) for (i, _), s in zip(rows, sets)]


def joined(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 60, 150]))] for _ in range(25)]
    hot, passage = [rng.choice(vocab) for _ in range(120)], [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(hot if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 7])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if i % 5 == 1:
            words += passage
        text = " ".join(words)
        rows.append((i * 3 + 1, text.upper() if i % 7 == 0 else text))
    return rows + [(9001, None), (9002, ""), (9003, " \n")]


def test_components_equal_brute_force(documents, monkeypatch):
    for seed, leaf, few in ((1, jaccard_join.LEAF, jaccard_join.FEW), (2, 6, 2), (3, 0, 0), (1, 2000, 0)):  # small leaves leave more to cells and far parts
        monkeypatch.setattr(jaccard_join, "LEAF", leaf)
        monkeypatch.setattr(jaccard_join, "FEW", few)
        rows = corpus(seed)
        assert joined(documents(rows)) == sorted(plain_components(rows))


def test_repeated_ids_are_one_document(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = documents([(3, b), (5, a), (5, b), (9, a)])
    assert {r[2] for r in joined(docs)} == {3}
    assert by_id(jaccard_join.drop_near_copies(docs)) == [(3, b), (5, a)]  # text a is no copy of b
    rng = random.Random(4)
    rows = [(rng.randrange(60), t) for _, t in corpus(3, 110)]
    assert joined(documents(rows)) == sorted(plain_components(rows))


def by_id(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def test_a_large_group_around_the_edge_is_not_paired(documents, monkeypatch):
    """Copies of one text with 0 to 14 of 400 words changed: some pairs link and some don't."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(rng.randrange(15)):
            words[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    made, kept = [], jaccard_join.stored

    def counting(df, name):
        out = kept(df, name)
        if name in ("join-pairs", "join-window", "join-leaves", "join-few"):
            made.append(out.select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counting)
    got = joined(documents(rows))
    sets = [plain_set(t) for _, t in rows]
    star = min(range(2000), key=lambda i: len(sets[i] - sets[0]) if i else 1000)
    near = [i for i in range(2000) if 100 * len(sets[i] & sets[star]) >= 80 * len(sets[i] | sets[star])]
    assert {got[i][2] for i in near} == {got[star][2]}  # whatever links with one text is of one component
    assert sum(made) < 2000 * 100  # all pairs are 1,999,000


def test_a_region_above_a_leaf_just_beyond_reach_is_not_paired(documents, monkeypatch):
    """Pages of 5 of 10 fixed sentences in any order: nearly all share sentences, few link, and regions pass LEAF."""
    rng = random.Random(13)
    sentences = [" ".join(f"s{k}w{i}" for i in range(20)) for k in range(10)]
    n = 1500
    rows = [(i, " ".join(rng.sample(sentences, 5))) for i in range(n)]
    made, kept = [], jaccard_join.stored

    def counting(df, name):
        out = kept(df, name)
        if name in ("join-pairs", "join-window", "join-leaves", "join-few"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counting)
    monkeypatch.setattr(jaccard_join, "LEAF", n // 6)
    got = joined(documents(rows))
    assert sum(made) < 100 * n  # all pairs are 750 a document
    sets = [plain_set(t) for _, t in rows]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    held = np.zeros((n, len(number)))
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    both, size = held @ held.T, held.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    label = np.arange(n)
    while True:
        least = np.array([label[linked[i]].min() for i in range(n)])
        if (least == label).all():
            break
        label = least
    assert got == [(i, len(sets[i]), int(label[i])) for i in range(n)]


def test_every_set_that_shares_a_first_token_meets_a_pivot(documents, monkeypatch):
    seen, kept = {}, jaccard_join.stored

    def keeping(df, name):
        out = kept(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(jaccard_join, "stored", keeping)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    joined(documents(corpus(5)))
    pivots = jaccard_join.elected(seen["join-rows"][0], 0)
    first = seen["join-rows"][0]
    in_region = first.join(pivots.select("region").distinct(), "region", "left_semi").select("c").distinct().count()
    assert in_region >= 0.9 * first.select("c").distinct().count()
    assert all(r["d"] <= 0.4 + 1e-9 for r in seen["join-near"][0].collect())


def test_join_on_awkward_and_empty_tables(awkward, empty):
    out = jaccard_join.jaccard_components(awkward).collect()
    assert len(out) == 10
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 4)} == {1}
    assert jaccard_join.drop_near_copies(awkward).columns == awkward.columns
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 100, 700):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.append(a[: n // 2], rng.integers(0, 1 << 62, n - n // 2).astype(np.uint64)))
        x, y = jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b)
        if len(x) == len(y):
            folded = x[: len(x) // 2] ^ x[len(x) // 2 :]
            if len(x) > 4:
                slots = ((a >> np.uint64(24)) & np.uint64(32 * len(x) - 1)).astype(int)
                assert (folded == np.packbits((np.bincount(slots, minlength=32 * len(x)) & 1).astype(np.uint8)).view(np.int64)).all()
            assert sum(((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) <= len(np.setxor1d(a, b))


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"a b c d e f", b"", b"  x ", "É a B c d e F".encode(), b"a b c d e f g"]
    together = shingles.shingle_sets(texts)
    for t, s in zip(texts, together):
        alone = shingles.shingle_sets([t])[0]
        assert s.tolist() == alone.tolist() and len(s) == len(plain_set(t.decode()))
    assert set(together[0].tolist()) < set(together[4].tolist())


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[259] == 200


def plain_cut(rows, length=200):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def cut(docs, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, **options).collect()}


def test_repeats_equal_brute_force(documents):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = noise(450), noise(230)
    rows = [(1, noise(300) + passage + noise(100)), (2, passage), (3, noise(50) + passage[:260] + noise(90)), (4, passage[100:340]), (5, noise(900)), (6, None), (7, "ab" * 400), (8, other + noise(20) + other), (9, passage[:199]), (10, "x" * 200), (11, "x" * 201), (12, noise(10) + "x" * 150)]
    near = list(noise(1500))
    for i in range(20, 45):
        copy = near.copy()
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "Z"
        rows.append((i, "".join(copy)))
    rows += [(60, noise(400)), (61, rows[-1][1])]
    assert cut(documents(rows)) == plain_cut(rows)
    assert cut(documents(rows), max_group=2) == plain_cut(rows)  # the way of large groups


def plain_extent(lefts, rights):
    side, out = repeats.SIDE, []
    whole = [(a, b) for a, b in zip(lefts, rights)]
    holds = lambda x, o: o <= len(x[0]) and side - o <= len(x[1])
    string = lambda x, o: (x[0][len(x[0]) - o :], x[1][: side - o])
    for i, x in enumerate(whole):
        met = [o for o in range(side + 1) if holds(x, o) and any(j != i and holds(y, o) and string(x, o) == string(y, o) for j, y in enumerate(whole))]
        out.append((-max(met), repeats.LENGTH - min(met)) if met else None)
    return out


def test_runs_of_the_order_give_the_shared_strings():
    rng = random.Random(9)
    letters = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    for n in [2, 3, 5, 9] * 20 + [80] * 4:  # 80 is past FEW
        bases = [letters(100), letters(100)]
        lefts, rights = [], []
        for _ in range(n):
            a, b, p, q = rng.choice(bases), rng.choice(bases), rng.randint(0, 100), rng.randint(0, 100)
            lefts.append((letters(100 - p) + a[100 - p :])[rng.choice([0, 0, rng.randint(0, 100)]) :])
            rights.append((b[:q] + letters(100 - q))[: rng.choice([100, 100, rng.randint(0, 100)])])
        assert repeats.shared_extent(lefts, rights) == plain_extent(lefts, rights)


def test_repeats_in_pieces_equal_whole_texts(documents, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcd") for _ in range(9000))
    b = [text.encode(), (text[4000:7000] + "q" * 500).encode()]
    whole = repeats.anchors(b)
    monkeypatch.setattr(repeats, "PIECE", 1500)
    pieces = repeats.anchors(b)
    key = lambda x: sorted(zip(*[c.tolist() for c in x]))
    assert key(whole) == key(pieces)


def test_repeats_on_awkward_and_empty_tables(awkward, empty):
    out = repeats.remove_repeats(awkward).collect()
    assert len(out) == 10
    assert all(r["n_removed"] == r["n_bytes"] for r in out if r["doc_id"] in (1, 4, 5))
    assert repeats.remove_repeats(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=25), st.integers(0, 30))
def test_deep_shallow_order_is_sorted_order(strings, shallow):
    order = deep_shallow_order(strings, shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=12))
def test_neighbour_prefixes(strings):
    def plain(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert all(common_prefix(a, b) == plain(a, b) for a in strings for b in strings)
    want = [max((plain(a, b) for j, b in enumerate(strings) if j != i), default=0) for i, a in enumerate(strings)]
    assert neighbour_prefixes(strings) == want


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney by its definition, on strings with four pads in front."""
    grams = [collections.Counter() for _ in range(6)]
    for t in texts:
        p = "\0" * 4 + t
        grams[5].update(p[i - 4 : i + 1] for i in range(4, len(p)))
    for k in range(4, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])
    v = len(grams[1])
    cuts = [None] + [kneser_ney.discounts(*[sum(c == i for c in grams[k].values()) for i in range(1, 5)]) for k in range(1, 6)]
    context = [collections.defaultdict(list) for _ in range(6)]
    for k in range(1, 6):
        for g, c in grams[k].items():
            context[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        d = lambda c: cuts[k][min(c, 3) - 1]
        held = context[k].get(g[:-1])
        if not held:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return (max(c - d(c), 0) if c else 0) / sum(held) + sum(map(d, held)) / sum(held) * p(g[1:])

    def perplexity(t):
        q = "\0" * 4 + t
        return math.exp(-sum(math.log(p(q[i - 4 : i + 1])) for i in range(4, len(q))) / len(t))

    return perplexity


def test_perplexity_equals_the_definition_and_both_joins_agree(spark, documents):
    texts = ["the cat sat on the mat and the dog sat too", "a cat and a dog on a mat", "the dog saw the cat", "mats are for cats, and dogs", "é è the café"] * 2
    model = kneser_ney.train(documents(list(enumerate(texts))))
    want = plain_kneser_ney(texts)
    probe = ["the cat", "zzz", "the dog sat on a mat", "café", "q" * 30]
    docs = documents([*enumerate(probe), (50, None), (51, "")])
    sent = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(docs, model).collect()}
    sharded = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(docs, model, max_sent_bytes=0).collect()}
    for i, t in enumerate(probe):
        assert abs(sent[i] / want(t) - 1) < 1e-6 and sent[i] == sharded[i]
    assert sent[50] is None and sharded[51] is None


def test_classifier_keeps_clean_text_and_rejects_junk(spark, documents):
    rng = random.Random(2)
    words = "the of and to in is that it was for on are as with his they at be this from".split()
    clean = lambda: " ".join(rng.choice(words) for _ in range(60))
    junk = lambda: "".join(rng.choice("XQZ#&%$!! ") for _ in range(200))
    rows = [(i, clean() if i % 4 else junk()) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(documents(rows), labels).collect()}
    assert sum(out[i] for i in range(400) if i % 4) >= 290 and not any(out[i] for i in range(0, 400, 4))


def test_every_code_point_is_a_symbol_of_its_own(spark, documents):
    texts = ["東京は日本の首都です。", "日本の首都は東京です\U0001f600\U0001f601", "საქართველო", "a\0b 漢字と仮名", "한국어 문장입니다"] * 2
    model = kneser_ney.train(documents(list(enumerate(texts))))
    want = plain_kneser_ney([t.replace("\0", "\U0010ffff") for t in texts])
    probe = ["日本の東京", "京東の本日", "\U0001f601\U0001f600", "a\0b", "ველო", "엄복동"]
    docs = documents(list(enumerate(probe)))
    for limit, error in ((kneser_ney.MAX_SENT_BYTES, 1e-6), (0, 1e-6)):
        got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(docs, model, limit).collect()}
        assert all(abs(got[i] / want(t.replace("\0", "\U0010ffff")) - 1) < error for i, t in enumerate(probe))


def test_classifier_rejects_shuffled_text_of_wide_scripts(spark, documents):
    rng = random.Random(5)
    words = "東京は 日本の 首都で 大阪は 西の 都市で 人々が 毎日 電車に 乗って 仕事へ 行きます 天気が 良い 公園を 歩く".split()
    clean = lambda: "".join(rng.choice(words) for _ in range(60))
    shuffled = lambda: (lambda x: rng.shuffle(x) or "".join(x))(list(clean()))
    rows = [(i, clean() if i % 4 else shuffled(), "ja") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(documents(rows), labels).collect()}
    assert sum(out[i] for i in range(400) if i % 4) >= 290 and not any(out[i] for i in range(0, 400, 4))


def test_classifier_on_awkward_and_empty_tables(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert kneser_ney.drop_rejected(awkward, some).columns == awkward.columns
        assert kneser_ney.classify(empty, some).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**62), unique=True, max_size=300), st.lists(st.integers(0, 2**62), max_size=50))
def test_hash_table_finds_what_it_holds(keys, others):
    table = kneser_ney.Hashed(np.array(keys, np.int64), np.arange(len(keys), dtype=np.float32))
    value, found = table.find(np.array(keys + others, np.int64))
    assert found.tolist() == [True] * len(keys) + [o in set(keys) for o in others]
    assert value[: len(keys)].tolist() == list(range(len(keys)))
