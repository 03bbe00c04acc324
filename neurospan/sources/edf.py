"""EDF and BDF recordings: fixed-record binary files, decoded where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, channel string, sfreq double, unit string, values array<double>, error string"


def decode(content: bytes) -> list[tuple[str, float, str, np.ndarray]]:
    """(label, sampling rate, unit, physical values) of every signal but annotations."""
    wide = content[:1] == b"\xff"  # BDF: 24-bit samples
    text = lambda a, z: content[a:z].decode("latin-1").strip()
    head, records, seconds, n = int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), int(text(252, 256))
    widths, fields, at = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32), [], 256
    for w in widths:
        fields.append([text(at + i * w, at + (i + 1) * w) for i in range(n)])
        at += n * w
    labels, _, units, pmin, pmax, dmin, dmax, _, counts, _ = fields
    counts = [int(c) for c in counts]
    size = 3 if wide else 2
    body = np.frombuffer(content, np.uint8, offset=head)
    per = sum(counts) * size
    records = len(body) // per if records < 0 else min(records, len(body) // per)
    body = body[: records * per].reshape(records, per)
    out, start = [], 0
    for i in range(n):
        raw = np.ascontiguousarray(body[:, start : start + counts[i] * size])
        start += counts[i] * size
        if labels[i].endswith("Annotations"):
            continue
        if wide:
            b = raw.reshape(-1, 3).astype(np.int32)
            digital = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
            digital = np.where(digital >= 1 << 23, digital - (1 << 24), digital)
        else:
            digital = raw.reshape(-1).view("<i2")
        lo, hi, a, z = float(dmin[i]), float(dmax[i]), float(pmin[i]), float(pmax[i])
        out.append((labels[i], counts[i] / seconds, units[i], (digital - lo) * (z - a) / (hi - lo) + a))
    return out


def read_recordings(spark: SparkSession, path: str, pattern: str = "*.[eb]df") -> DataFrame:
    """A row for each file and channel; a file that can't be decoded is one row with the error.

    A task holds one file at a time. Files of any size are one record each to Spark, so recordings
    of many gigabytes should be cut before they get here.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(file, name, rate, unit, values, None) for name, rate, unit, values in decode(bytes(content))]
                except (ValueError, IndexError, ZeroDivisionError) as e:
                    rows = [(file, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "channel", "sfreq", "unit", "values", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
