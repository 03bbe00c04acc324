"""Token counts, periodic runs and conversation repair, held to plain versions."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from neurospan.llm import periodic_runs as pr
from neurospan.llm import token_counts as tc
from neurospan.llm import turn_repair as tr

ODD = [*"aAbzZsStTmMdDrReEvVlL''''\"<|>.,!?-019 \t\n\x0b\x0c\r\x1c\x00", *"éÉüßſİıŉªµ²×̧́\u0085\xa0　漢かЖΣςKﬁ😀", "<|endoftext|>", "<|startoftext|>", "'ll"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tc.VOCABULARY))


def n_tokens(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_tokenizers(spark, documents, tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " \n", "x" * 5000, "漢" * 3000, "don't " * 9000, "Größe, çà et l'été <|endoftext|>" * 50]
    docs = documents(list(enumerate(texts))).repartition(5)
    for keep in (tc.FREQUENT, 3):  # the tiers' sizes change nothing
        out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(docs, keep=keep).collect()}
        assert out == {i: (len((t or "").encode()), n_tokens(tokenizer, t)) for i, t in enumerate(texts)}


def test_a_full_cache_starts_again(tokenizer, monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 5)
    with open(public_tokenizers.path(tc.VOCABULARY), encoding="utf-8") as f:
        counts = tc.Counts(tc.checked(f.read()), b"the\nof", bytes([1, 0, 1, 0]))
    for text in ("the quick brown fox jumps over the lazy dog of dogs", "ünïcode ẞ <|endoftext|> " + "y" * 100):
        assert counts.count(text) == n_tokens(tokenizer, text)
        assert len(counts) <= 2 + 5 + 1


def test_plain_letters_are_normalised_alone(tokenizer):
    for c in map(chr, range(0x250)):
        if not tc.OTHER.search(c) and not tc.WHITE.search(c):
            assert len(tokenizer.normalizer.normalize_str(c)) == 1


def test_other_tokenizers_are_refused(spark, documents):
    with pytest.raises(ValueError):
        tc.token_counts(documents([(1, "a")]), public_tokenizers.path("byte_bpe_50k.json"))


def test_summaries_keep_what_is_frequent():
    rng = random.Random(2)
    parts = [tc.Counter(rng.choices(["hot", "warm", *map(str, range(500))], [300, 100, *[1] * 500], k=2000)) for _ in range(20)]
    merged = tc.Counter()
    for p in parts:
        merged.update(tc.heavy(p, 20))
        merged = tc.heavy(merged, 20)
    assert len(merged) <= 20 and {"hot", "warm"} <= set(merged)


def test_counts_of_awkward_tables(spark, awkward, empty, tokenizer):
    assert tc.token_counts(empty).count() == 0
    rows = tc.token_counts(awkward).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(r["doc_id"]), n_tokens(tokenizer, r["text"])) for r in awkward.collect())
    assert set(awkward.columns) < set(rows[0].asDict())


def plain_runs(words, least=12):
    """Runs by trying every period at every place."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j + q - i) not in found:
                found[i, j + q - i] = q
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def sequences():
    rng = random.Random(3)
    for k in range(400):
        letters = "ab" if k % 3 == 0 else "abc" if k % 3 == 1 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):  # repeated blocks, with neighbours that extend them or not
            block = [rng.choice(letters) for _ in range(rng.randint(1, 15))]
            at = rng.randint(0, len(words))
            words[at:at] = (block * rng.randint(2, 9))[: rng.randint(4, 60)]
        yield words
    yield fibonacci(300)
    yield ["a"] * 200
    yield list("ab" * 60 + "c" + "ab" * 60)
    yield [bin(i).count("1") % 2 for i in range(256)]


def test_runs_are_all_and_whole():
    for words in sequences():
        words = [str(w) for w in words]
        want = plain_runs(words)
        assert pr.text_runs(words) == sorted(want, key=lambda r: (r[0], r[2]))
        every = sorted(plain_runs(words, 2), key=lambda r: (r[0], r[2]))
        assert pr.runs_of([ord(w) for w in words], 2) == every  # the factors alone, without stretches
        assert pr.kept_words(words, want) == plain_kept(words, want)


def test_stretches_hold_every_run():
    import numpy as np

    for words in sequences():
        found = pr.stretches(np.array([ord(str(w)) for w in words], np.int64))
        for s, n, _ in plain_runs([str(w) for w in words]):
            assert any(a <= s and s + n <= z for a, z in found)


def test_hash_collisions_are_seen(monkeypatch):
    monkeypatch.setattr(pr.Extents, "same", lambda self, i, j, n: True)
    for words in itertools.islice(sequences(), 60):
        ids = [ord(w) for w in words]
        assert pr.runs_of(ids, 2) == sorted(plain_runs(words, 2), key=lambda r: (r[0], r[2]))


def test_long_periodic_texts_stay_near_linear():
    rng = random.Random(4)
    block = [f"w{rng.randint(0, 40)}" for _ in range(700)]
    start = time.process_time()
    for words in (block * 200, ["a", "b", "a"] * 50_000, [str(w) for w in fibonacci(100_000)]):
        assert pr.text_runs(words)
    assert time.process_time() - start < 60


def op12_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(plain_kept(words, runs))))


def test_op12_on_a_table(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [rng.choice("the of and to in é".split()) if i % 2 else f"w{rng.randint(0, 900)}" for _ in range(rng.randint(0, 120))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (20, None), (None, "a " * 30), (7, "x y " * 20), (7, "x y " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = pr.op12_lyndon_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [op12_row(i, t) if i is not None else (None, *op12_row(1, t)[1:]) for i, t in rows]  # 1 isn't planted, nor is null
    assert zlib.crc32(b"1") % 10 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))


def test_runs_of_awkward_tables(spark, awkward, empty):
    assert pr.periodic_runs(empty).count() == 0
    out = pr.periodic_runs(awkward).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in awkward.collect())
    given = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in awkward.collect() if r["doc_id"] != 7}
    assert all(r["collapsed"].split(" ") == (given[r["doc_id"]] or [""]) for r in out if r["doc_id"] in given and not r["runs"])


WHITE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WHITE)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """Cheapest edits by trying all of them, up to two inserts in a gap."""
    adds = [()] + [(x,) for x in "ua"] + [tuple(x) for x in itertools.product("ua", repeat=2)]
    best = None

    def go(k, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in adds:
            c, a, o = cost + 2 * len(more), audit + "I" * len(more), out + [({"u": "user", "a": "assistant"}[x], "") for x in more]
            if k == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text = rows[k]
            extra = 1 if faults[k] == 3 else 0
            go(k + 1, c + 3, a + "D", o)
            if faults[k] not in (1, 2):
                go(k + 1, c + extra, a + "K", [*o, (role, text)])
                for new in ("user", "assistant"):
                    go(k + 1, c + extra + 2, a + "R", [*o, (new, text)])

    go(0, 0, "", [])
    return best


def conversations(rng, n):
    texts = ["Yes.", "No", "Hm? ", "", " \n", "Why!\x0b", "so", " "]
    rows = []
    for c in range(n):
        turns = sorted(rng.choices(range(6), k=rng.randint(0, 3)))
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice([*texts, None])) for t in turns]
    return rows


def test_repair_is_the_cheapest(spark):
    rows = conversations(random.Random(6), 150)
    out = {r["conv_id"]: r for r in tr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert set(out) == {r[0] for r in rows}
    for c, r in out.items():
        mine = sorted(((t is not None, t or 0, role or " " if role is not None else " ", " " if text is None else text) for i, t, role, text in rows if i == c))
        turns = [(role, text) for _, _, role, text in mine]
        faults = plain_faults(turns)
        cost, audit, left = plain_best(turns, faults)
        numbers = [t for has, t, _, _ in mine if has]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        want = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, left)
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], [tuple(x) for x in r["repaired"]]) == want


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {t}. ") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    out = tr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows[:-1]} >= {0, 1, 2, 3, 4}


def test_op13_on_awkward_rows_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", "Is it? Yes!", " "])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (900, 3, "user", None), (901, 5, "user", "x."), (901, 5, "assistant", "y."), (901, 5, "assistant", "y."), (902, -4, "user", "😀"), (902, 7, "sage", "é.")]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(300)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, live string, position int")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    out = tr.op13_turn_repair(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    duck.execute(tr.SQL)
    columns = [d[0] for d in duck.description]
    assert out.columns == columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, duck.fetchall()))


def test_op13_without_rows(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    row = tr.op13_turn_repair(spark, str(tmp_path)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tr.repair(none).count() == 0
    assert json.loads(tr.repair(spark.createDataFrame([(1, "a", "b", 1, "user", "A?")], "conv_id long, key string, _key string, turn long, role string, text string")).toJSON().first())["audit"] == "KI"
