"""Personal data: base patterns, and weakly supervised span candidates judged over the corpus.

Regex, gazetteer and context labelers vote on every candidate span. Expectation-maximisation turns
the counts of vote patterns into the labelers' reliabilities for each kind and soft labels, and a
logistic span classifier, trained on those over the shape of the value and the words around it,
decides which candidates join the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.llm.common import sent_if_small, stored, table, text_or_empty

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "ssn", "iban", "name", "handle")
KINDS = BASE + MORE

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match can only start where a run of digits does, since every match is greedy to the end of one
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

CANDIDATES = (
    ("local_phone", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{1,4}(?![A-Za-z0-9])")),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?|\b[Nn]ame: [A-Z][a-z]+(?: [A-Z][a-z]+)?")),
    ("handle", re.compile(r"@[A-Za-z0-9_]{3,}")),
)
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
TOLL_FREE = frozenset("800 833 844 855 866 877 888 900".split())
CUES = re.compile(r"(?i)\b(?:call|phone|tel|fax|mobile|contact|email|e-mail|mail|reach|ssn|social|iban|account|bank|card|visa|ip|host|address|name|dear|follow|user|signed)\b")
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|page|figure|table|section|invoice|build|release|example|sample|test)\b")
CONTEXT = 40
#: Documents in whose name candidates a word stands before the gazetteer holds it.
NAME_DOCS = 3
#: Numbers that the classifier's features are hashed to, and the most characters of a feature.
FEATURES, FEATURE_CHARS = 4096, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base patterns, sorted; failing matches are not retried."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _regex_vote(kind: str, value: str) -> int:
    digits = NOT_DIGIT.sub("", value)
    if kind == "ssn":
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    if kind == "local_phone":
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    if kind == "iban":
        bare = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else -1
    if kind == "name":
        return 1 if value.count(" ") >= 2 else 0
    if kind == "handle":
        return 1 if not value[1:].isdigit() else -1
    return 1


def _gazetteer_vote(kind: str, value: str) -> int:
    """By fixed tables; names are looked up later, in what the corpus holds."""
    if kind == "iban":
        return 1 if value[:2] in IBAN_COUNTRIES else -1
    if kind in ("local_phone", "phone"):
        return -1 if NOT_DIGIT.sub("", value)[-10:-7] in TOLL_FREE else 0
    return 0


def name_words(kind: str, value: str) -> list[str]:
    """Words that a gazetteer of names could hold: of a name without its title, and of an address before the @."""
    if kind == "name":
        return [w.lower() for w in re.findall(r"[A-Za-z]+", value)[1:]]
    if kind == "email":
        return [w for w in re.findall(r"[a-z]+", value.split("@")[0].lower()) if len(w) > 2]
    return []


def shape(value: str) -> str:
    """Runs of digits, capitals and small letters with their lengths; other characters as they are."""
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value[:4 * FEATURE_CHARS])
    runs = re.sub(r"([0Aa])\1*", lambda m: f"{m[1]}{len(m[0])}", kinds)
    return runs[:FEATURE_CHARS]


WORD_BEFORE = re.compile(r"(\w+)\W*$")
WORD_AFTER = re.compile(r"\w+")


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span, in small letters, within CONTEXT characters."""
    before, after = WORD_BEFORE.search(text[max(0, start - CONTEXT) : start]), WORD_AFTER.search(text[end : end + CONTEXT])
    return before[1].lower()[:FEATURE_CHARS] if before else "", after[0].lower()[:FEATURE_CHARS] if after else ""


def _context_vote(text: str, start: int) -> int:
    before = text[max(0, start - CONTEXT) : start]
    return -1 if AGAINST.search(before) else 1 if CUES.search(before) else 0


def code_of(kind: int, votes: tuple[int, int, int]) -> int:
    """kind and three votes, packed: 27 codes a kind."""
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code


def unpack(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in range(3):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1]


def apart(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    return starts, ends


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind's index, end, code) of base spans and of candidates that touch none of them."""
    def one(start: int, k: int, end: int) -> tuple[int, int, int, int]:
        value = text[start:end]
        return start, k, end, code_of(k, (_regex_vote(KINDS[k], value), _gazetteer_vote(KINDS[k], value), _context_vote(text, start)))

    out = [one(s, k, e) for s, k, e in base]
    starts, ends = apart([(s, e) for s, _, e in base])
    has_digit, has_at = DIGIT.search(text), "@" in text
    for kind, pattern in CANDIDATES:
        if kind == "handle" and not has_at or kind in ("local_phone", "ssn", "iban") and not has_digit:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            i = bisect_left(starts, e)
            if s and text[s - 1].isalnum() or i and ends[i - 1] > s:
                continue
            out.append(one(s, KINDS.index(kind), e))
            starts.insert(i, s), ends.insert(i, e)
    return sorted(out)


ITEM = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32()), ("shape", pa.string()), ("before", pa.string()), ("after", pa.string()), ("names", pa.list_(pa.string()))])
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, items array<struct<kind:string,start:long,end:long,code:int,shape:string,before:string,after:string,names:array<string>>>"


def _item(text: str, start: int, k: int, end: int, code: int) -> dict:
    before, after = around(text, start, end)
    value = text[start:end]
    return {"kind": KINDS[k], "start": start, "end": end, "code": code, "shape": shape(value), "before": before, "after": after, "names": name_words(KINDS[k], value)}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, items = [[0] * batch.num_rows for _ in BASE], [], []
        for row, text in enumerate(batch.column("text")):
            text = text.as_py()
            base = base_spans(text)
            for _, k, _ in base:
                counts[k][row] += 1
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            items.append([_item(text, *x) for x in candidates(text, base)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas), pa.array(items, pa.list_(ITEM))],
            names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "items"],
        )


def fit_em(counts: dict[int, int], rounds: int = 50, pooled: float = 10.0) -> dict[int, float]:
    """Posterior that a span of a code is personal data, from the codes' counts alone.

    Two classes; each kind has its own prior and, for every labeler and class, its own distribution
    of votes, drawn towards that of all kinds with the weight of pooled spans. Starts from the
    majority vote, so the positive class is the one labelers agree on.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    parts = [unpack(c) for c in codes]
    kind = np.array([p[0] for p in parts])
    votes = np.array([p[1] for p in parts]).reshape(-1, 3) + 1
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1) - 0.5 * (kind < len(BASE))))
    for _ in range(rounds):
        like = np.zeros((len(codes), 2))
        for y, weight in enumerate((n * (1 - post), n * post)):
            for j in range(3):
                every = np.bincount(votes[:, j], weight, 3) + 1.0
                own = np.bincount(kind * 3 + votes[:, j], weight, 3 * len(KINDS)).reshape(-1, 3) + pooled * every / every.sum()
                like[:, y] += np.log(own / own.sum(1, keepdims=True))[kind, votes[:, j]]
            prior = (np.bincount(kind, weight, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
            like[:, y] += np.log(prior[kind])
        post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return dict(zip(codes, post.tolist(), strict=True))


def with_names(spans: DataFrame) -> DataFrame:
    """spans (_row, kind, code, names, ...) with the code's gazetteer vote raised where a name is known.

    The gazetteer is learnt: words that stand in name candidates of NAME_DOCS documents or more.
    """
    words = spans.filter("kind = 'name'").select("_row", F.explode("names").alias("name")).distinct()
    known = stored(words.groupBy("name").count().filter(F.col("count") >= NAME_DOCS).select("name"), "pii-names")
    hits = spans.select("_row", "start", "kind", F.explode("names").alias("name")).join(sent_if_small(known, 100), "name")
    hits = hits.select("_row", "start", "kind").distinct().withColumn("_named", F.lit(True))
    none = F.floor(F.col("code") / 3) % 3 == 1  # the gazetteer has not voted
    raised = spans.join(hits, ["_row", "start", "kind"], "left")
    return raised.withColumn("code", F.when(F.col("_named") & none, F.col("code") + 3).otherwise(F.col("code"))).drop("_named", "names")


def classified(spans: DataFrame, posterior: dict[int, float]) -> DataFrame:
    """spans with p, the span classifier's probability.

    Logistic regression over hashed features: the kind, the shape of the value and the words before
    and after it, each together with the kind. The labelers' votes are no features: what they say
    enters as soft labels, a span being an example of both classes by its posterior.
    """
    soft = spans.sparkSession.createDataFrame([(c, p) for c, p in posterior.items()], "code int, soft double")
    spans = spans.join(F.broadcast(soft), "code")
    with_kind = lambda name: F.concat_ws("|", F.lit(name), "kind", name).alias(f"_{name}")
    rows = spans.select("*", with_kind("shape"), with_kind("before"), with_kind("after"), F.concat_ws("|", F.lit("kind"), "kind").alias("_kind"))
    hashed = stored(FeatureHasher(inputCols=["_kind", "_shape", "_before", "_after"], outputCol="_features", numFeatures=FEATURES).transform(rows), "pii-features")
    sides = hashed.select("_features", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("soft").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("soft")).alias("w")))).alias("x"))
    train = sides.select("_features", "x.y", F.greatest("x.w", F.lit(1e-6)).alias("w"))
    model = LogisticRegression(featuresCol="_features", labelCol="y", weightCol="w", regParam=1e-3, maxIter=30, probabilityCol="_probability").fit(train)
    return model.transform(hashed).withColumn("p", vector_to_array("_probability")[1])


def joined(items: Column) -> Column:
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("s"), rank(x).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, counts and digest of base spans, items (kind, start, end of all spans).

    The corpus is read once; what the labelers say is counted by code over all documents, and there
    are 243 codes whatever the corpus holds, so the counts fit the driver. Names and the classifier
    are learnt from the table of spans. Base spans stay whatever the classifier says. Null or empty
    texts have no spans; a very long text is read whole, in time that grows with its spans. Rows that
    repeat are judged alike; spans that start together are told in the order of the kinds, and of
    candidates that touch the kind listed first stays. Without candidates nothing is trained; extra
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = stored(rows.mapInArrow(_scan, SCHEMA).withColumn("_row", F.monotonically_increasing_id()), "pii-spans")
    spans = stored(with_names(rows.select("_row", F.inline("items"))), "pii-candidates")
    counts = {r["code"]: r["n"] for r in spans.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if counts:
        judged = classified(spans, fit_em(counts))
        kept = judged.filter(F.col("kind").isin(*BASE) | (F.col("p") >= threshold))
    else:
        kept = spans
    kept = kept.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("items"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return rows.drop("items").join(kept, "_row", "left").withColumn("items", F.coalesce("items", none)).drop("_row")


def op1_weak_supervision(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", joined(F.col("items")).alias("spans"))
