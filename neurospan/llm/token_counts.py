"""Token counts by a two-tier lookup inside the tasks that read the texts: no pre-token is ever shuffled."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm.common import WORD, lean, small_batches, stored, table, text_or_empty

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens of the first tier, and of a task's summary from which it is merged.
FREQUENT = 65_536
#: Pre-tokens a worker remembers beyond the first tier; then it forgets them all and starts again.
CACHED = 200_000
#: Characters of the longest pre-token that either tier holds.
LONGEST = 64
#: Summaries that one task merges.
FAN = 64

#: Letters that stay single letters under composition and lower-casing: ASCII, Latin-1, Latin Extended A and B without U+0130.
LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPACES = r"\x20\x09-\x0D"
#: The vocabulary's own pre-token pattern for text of ASCII and these letters, cases kept.
UNIT = re.compile(rf"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{LETTER}]+|[0-9]|[^{SPACES}0-9{LETTER}]+")
OTHER = re.compile(rf"[^\x00-\x7f{LETTER}]|<\|")
WORDS, WHITE = re.compile(WORD), re.compile(f"[{SPACES}]")


def units(text: str) -> list[str]:
    """Pieces of a text whose token counts add up to the text's.

    White space splits every text: no token crosses it, it composes with nothing, and it gives no token.
    Words of ASCII and plain Latin letters are split further, as the vocabulary's pattern splits them; a
    word with any other character, or with what could open a special token, stays one piece, and the
    tokenizer itself splits it.
    """
    if not OTHER.search(text):
        return UNIT.findall(text)
    out: list[str] = []
    for word in WORDS.findall(text):
        if OTHER.search(word):
            out.append(word)
        else:
            out += UNIT.findall(word)
    return out


def checked(vocabulary: str) -> str:
    """The tokenizer file's JSON, if pieces may be counted apart under it: word ends, white space dropped, lower case."""
    spec = json.loads(vocabulary)
    model, normal, splits = spec["model"], spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    first = splits[0] if splits else {}
    fits = (
        model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout") and kinds == ["NFC", "Replace", "Lowercase"]
        and first.get("behavior") == "Removed" and first.get("invert") is True
        and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError("counts of pieces don't add up under this tokenizer: it isn't one with word ends that drops white space")
    return vocabulary


class Counts(dict):
    """Token counts by piece: the frequent ones, sent to every worker, and what this worker met besides."""

    def __init__(self, vocabulary: str, words: bytes, lengths: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, range(0x250)) if not OTHER.search(c) and not WHITE.search(c)]
        self.mapped = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))[0][0] for c in letters}
        self.frequent = dict(zip(words.decode().split("\n"), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if words else {}
        super().__init__(self.frequent)

    def __missing__(self, piece: str) -> int:
        if OTHER.search(piece):
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        else:  # one pre-token of letters that are normalised one by one: only the merges are left to do
            n = len(self.model.tokenize(piece.translate(self.mapped)))
        if len(piece) <= LONGEST:
            if len(self) > len(self.frequent) + CACHED:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, units(text)))


#: Of each Python worker: its counts, kept from task to task while the first tier stays the same.
_WORKER: dict[str, Counts] = {}


def worker_counts(sent) -> Counts:
    vocabulary, words, lengths, key = sent.value
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counts(vocabulary, words, lengths)
    return _WORKER[key]


def heavy(counts: Counter, keep: int) -> Counter:
    """At most keep of the counts, all lowered by the first one left out, so what remains is a lower bound.

    A piece that makes up more than 1 / keep of what was counted is always among them, also
    after any number of merges.
    """
    if len(counts) <= keep:
        return counts
    ranked = counts.most_common(keep + 1)
    cut = ranked[-1][1]
    return Counter({p: c - cut for p, c in ranked[:-1] if c > cut})


def frequent_pieces(docs: DataFrame, text_col: str = "text", keep: int = FREQUENT) -> list[str]:
    """Pieces that are frequent in all of docs, keep of them at most.

    Each task sums up its texts in keep counters and emits one row; FAN rows are merged at a time, in
    a tree as deep as the logarithm of the tasks. So what is shuffled grows with the tasks, and the driver
    reads one row.
    """
    schema = "slot int, pieces array<string>, counts array<long>"

    def row(slot: int, counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"slot": pd.Series([slot], dtype="int32"), "pieces": [list(counts)], "counts": [list(counts.values())]})

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        counts: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                counts.update(units(text))
                if len(counts) > 4 * keep:
                    counts = heavy(Counter({p: c for p, c in counts.items() if len(p) <= LONGEST}), keep)
        yield row(TaskContext.get().partitionId(), heavy(Counter({p: c for p, c in counts.items() if len(p) <= LONGEST}), keep))

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for pieces, n in zip(frame["pieces"], frame["counts"], strict=True):
            counts.update(dict(zip(pieces, n, strict=True)))
        return row(int(key[0]), heavy(counts, keep))

    level = stored(docs.select(text_or_empty(text_col).alias("text")).mapInPandas(summarise, schema), "pieces-0")
    n, depth = level.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0], 0
    while n > 1:
        depth, n = depth + 1, -(-n // FAN)
        level = stored(level.groupBy(F.floor(F.col("slot") / FAN).cast("int").alias("slot")).applyInPandas(merge, schema), f"pieces-{depth}")
    last = level.select("pieces").first()  # one row of keep pieces at most
    return list(last[0]) if last else []


def token_counts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", keep: int = FREQUENT) -> DataFrame:
    """docs with n_bytes and n_tokens added: the UTF-8 bytes of the text and the tokens the tokenizer gives it.

    vocabulary is the path of a tokenizer's JSON on the driver (default: the public VOCABULARY); the file
    is sent to the workers. Counts are those of the tokenizer for the whole text without added tokens; its
    special strings inside a text are one token each, as its default has it. A null or empty text, or one
    of white space, has no tokens. Rows are counted one by one, so repeats and ties don't matter; columns
    named n_bytes or n_tokens are replaced, all others stay. An empty table gives no rows.

    First tier: the frequent pieces of all texts with their counts, keep of them at most, packed into one
    string and two bytes a count. Second tier: each worker remembers what else it met, CACHED pieces at a
    time. A piece in neither is encoded by the tokenizer's own rules, so both sizes change the time only. Pieces
    longer than LONGEST are encoded each time.
    """
    spark = docs.sparkSession
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        text = checked(f.read())
    pieces = frequent_pieces(docs, text_col, keep)
    lengths = np.array(list(map(Counts(text, b"", b"").__getitem__, pieces)), np.uint16).tobytes()
    words = "\n".join(pieces).encode()
    sent = spark.sparkContext.broadcast((text, words, lengths, f"{hash(text)}-{hash(words)}"))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean()
        counts = worker_counts(sent)
        for batch in batches:
            yield pd.Series([counts.count(t) for t in batch], dtype="int64")

    small_batches(spark)
    whole = text_or_empty(text_col)
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": count(whole)})


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
