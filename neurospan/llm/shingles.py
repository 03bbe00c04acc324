"""Sets of hashed word shingles, computed for many texts at once by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from neurospan.llm.repeats import BYTE, mixed, powers

WORDS = 5
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PLACE = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes, with the index of the first; a longer text is alone."""
    start, run, size = 0, [], 0
    for i, b in enumerate(texts):
        if run and size + len(b) > CHUNK:
            yield start, run
            start, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield start, run


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an array that isn't empty; faster on short arrays than np.unique."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of WORDS words, A-Z lower-cased.

    Fewer words are one shingle; a text without words has none. A shingle is known by 64 bits.
    """
    b = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in texts])
    space = SPACE[b]
    edge = np.diff(np.concatenate([[1], space.astype(np.int8)]))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = powers(max(len(b) + 1, 2 * CHUNK))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * power[: len(b)], out=sums[1:])
    words = mixed((sums[last] - sums[first]) * inverse[first])
    n = len(words)
    if n >= WORDS:
        whole = np.zeros(n - WORDS + 1, np.uint64)
        for k in range(WORDS):
            whole += words[k : n - WORDS + 1 + k] * PLACE[k]
        whole = mixed(whole)
    stops = np.searchsorted(first, ends)
    out, a = [], 0
    for z in stops.tolist():
        if z - a >= WORDS:
            out.append(distinct(whole[a : z - WORDS + 1]))
        elif z > a:
            out.append(mixed((words[a:z] * PLACE[: z - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
        a = z
    return out


def set_hash(tokens: np.ndarray) -> int:
    """64 bits of a set, whatever the order, as a signed number."""
    return int(mixed(mixed(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])
