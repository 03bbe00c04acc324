"""Recordings written as BrainVision files, one after the other by the tasks that hold their samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = """Brain Vision Data Exchange Header File Version 1.0
[Common Infos]
Codepage=UTF-8
DataFile={name}.eeg
DataFormat=BINARY
DataOrientation=MULTIPLEXED
NumberOfChannels={n}
SamplingInterval={interval}
[Binary Infos]
BinaryFormat=IEEE_FLOAT_32
[Channel Infos]
{channels}
"""


def write_brainvision(df: DataFrame, path: str, sfreq: float, rec: str = "rec_id", idx: str = "sample_idx", values: str = "values", unit: str = "µV") -> DataFrame:
    """Writes each recording of df (a row for each sample, values an array by channel) and returns path, samples of each file.

    Samples go to tasks by recording, in order, and a task appends them to its file batch by batch, so it
    holds no recording whole. A file gets its name only when it is complete: a task that runs again
    writes its own draft, and the last one to finish replaces an equal file.
    """
    rows = df.select(F.col(rec).cast("string").alias("rec"), F.col(values).cast("array<float>").alias("values"), F.col(idx).alias("idx")).repartition("rec").sortWithinPartitions("rec", "idx").drop("idx")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get().taskAttemptId()
        name, out, n, width = None, None, 0, 0
        done: list[dict] = []

        def close() -> None:
            if out is None:
                return
            out.close()
            channels = "\n".join(f"Ch{i + 1}=C{i},,1,{unit}" for i in range(width))
            with files.open_output_stream(f"{root}/_{name}.vhdr.{task}") as f:
                f.write(HEADER.format(name=name, n=width, interval=1e6 / sfreq, channels=channels).encode())
            for ending in ("eeg", "vhdr"):
                files.move(f"{root}/_{name}.{ending}.{task}", f"{root}/{name}.{ending}")
            done.append({"path": f"{root}/{name}.vhdr", "samples": n})

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != name:
                    close()
                    name, n, width = key, 0, len(x)
                    out = files.open_output_stream(f"{root}/_{name}.eeg.{task}")
                out.write(np.asarray(x.values, "<f4").tobytes())
                n += 1
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("samples", pa.int64())]))

    return rows.mapInArrow(write, "path string, samples long")
