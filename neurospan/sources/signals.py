"""Raw recordings as a data source: EDF, BDF and BrainVision files, read by ranges of their records."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "path string, channel string, sfreq double, unit string, sample long, time double, value double, error string"
ARROW = pa.schema([("path", pa.string()), ("channel", pa.string()), ("sfreq", pa.float64()), ("unit", pa.string()), ("sample", pa.int64()), ("time", pa.float64()), ("value", pa.float64()), ("error", pa.string())])
#: Raw formats that are read here, by extension in any case, and those whose readers are absent.
READ, ABSENT = ("edf", "bdf", "vhdr"), ("fif", "set", "cnt", "cdt")
#: Sample types by their names in a BrainVision header.
BINARY = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "UINT_16": "<u2"}
#: Samples of a batch of rows, and bytes between wanted pieces that are read along with them.
BATCH, GAP = 1 << 18, 1 << 16


@dataclass
class Channel:
    name: str
    unit: str
    gain: float
    shift: float
    #: Samples in a record, and where they begin in it.
    count: int
    at: int


@dataclass
class Layout:
    """Where the samples of a recording lie: records of one size, in each the samples of every channel."""

    data: str
    head: int
    record: int
    seconds: float
    kind: str
    channels: list[Channel]
    #: The file's records, -1 where its size tells.
    records: int = -1
    #: Channel after channel over the whole file, instead of records.
    by_channel: bool = False

    @property
    def width(self) -> int:
        return 3 if self.kind == "int24" else np.dtype(self.kind).itemsize


def edf_layout(path: str, read) -> Layout:
    """Layout of an EDF or BDF file from its header; annotation signals are left out."""
    start = read(0, 256)
    if len(start) < 256:
        raise ValueError("the header is cut off")
    text = lambda b: b.decode("latin-1").strip()
    head, records, seconds, n = int(text(start[184:192])), int(text(start[236:244])), float(text(start[244:252])), int(text(start[252:256]))
    rest, fields, at = read(256, 256 * n), [], 0
    if len(rest) < 256 * n:
        raise ValueError("the header is cut off")
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(rest[at + i * width : at + (i + 1) * width]) for i in range(n)])
        at += n * width
    kind = "int24" if start[:1] == b"\xff" else "<i2"
    channels, at = [], 0
    for i in range(n):
        count = int(fields[8][i])
        low, high, least, most = (float(fields[k][i]) for k in (3, 4, 5, 6))
        if not fields[0][i].endswith("Annotations"):
            gain = (high - low) / (most - least)
            channels.append(Channel(fields[0][i], fields[2][i], gain, low - least * gain, count, at))
        at += count * (3 if kind == "int24" else 2)
    return Layout(path, head, at, seconds, kind, channels, records)


def brainvision_layout(path: str, read) -> Layout:
    """Layout of a BrainVision recording from its text header; the samples lie in the file the header names."""
    section, said = "", {}
    for line in read(0, 1 << 24).decode("utf-8", "replace").splitlines():
        line = line.strip()
        if line.startswith("["):
            section = line.strip("[]").lower()
        elif "=" in line and not line.startswith(";"):
            key, value = line.split("=", 1)
            said[section, key.strip().lower()] = value.strip()
    common = lambda key: said["common infos", key]
    if common("dataformat").upper() != "BINARY":
        raise ValueError("samples are read in binary form only")
    kind, n = BINARY[said["binary infos", "binaryformat"].upper()], int(common("numberofchannels"))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    data = path.rsplit("/", 1)[0] + "/" + common("datafile").replace("$b", stem)
    by_channel = said.get(("common infos", "dataorientation"), "MULTIPLEXED").upper() == "VECTORIZED"
    width, channels = np.dtype(kind).itemsize, []
    for i in range(n):
        parts = [p.replace(r"\1", ",") for p in said["channel infos", f"ch{i + 1}"].split(",")] + ["", "", ""]
        channels.append(Channel(parts[0], parts[3] or "µV", float(parts[2] or 1), 0.0, 1, i * width))
    return Layout(data, 0, n * width, float(common("samplinginterval")) / 1e6, kind, channels, by_channel=by_channel)


def physical(raw: bytes, kind: str) -> np.ndarray:
    if kind != "int24":
        return np.frombuffer(raw, kind).astype(np.float64)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v).astype(np.float64)


class Wanted:
    """What filters leave of paths, channels, sample numbers and times; everything at first."""

    def __init__(self) -> None:
        self.names: dict[str, set[str]] = {}
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def add(self, f: ds.Filter) -> None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in ("path", "channel") and isinstance(f, (ds.EqualTo, ds.In)):
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.names[column] = self.names.get(column, values) & values
        if column in ("sample", "time"):
            if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                self.low[column] = max(self.low.get(column, -math.inf), f.value)
            if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                self.high[column] = min(self.high.get(column, math.inf), f.value)

    def takes(self, column: str, value: str) -> bool:
        return column not in self.names or value in self.names[column]

    def records(self, layout: Layout, channels: list[Channel], first: int, end: int) -> tuple[int, int]:
        """Records of [first, end) that hold wanted samples of the channels."""
        if "time" in self.low:
            first = max(first, math.floor(self.low["time"] / layout.seconds) - 1)
        if "time" in self.high:
            end = min(end, math.floor(self.high["time"] / layout.seconds) + 2)
        counts = [c.count for c in channels if c.count] or [1]
        if "sample" in self.low:
            first = max(first, math.floor(self.low["sample"] / max(counts)))
        if "sample" in self.high:
            end = min(end, math.floor(self.high["sample"] / min(counts)) + 1)
        return first, end


@dataclass
class Piece(ds.InputPartition):
    path: str
    data_size: int
    start: int
    end: int


class SignalReader(ds.DataSourceReader):
    """Deals each file's bytes to partitions of blockBytes; tasks read headers, the driver lists files only.

    Equalities of path and channel and bounds of sample and time choose files, records and the bytes in
    them; Spark applies the filters again, so they are exact. A file that can't be decoded gives one row with the error.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.wanted, self.bytes_read = options, Wanted(), 0

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            self.wanted.add(f)
            yield f

    def _files(self) -> tuple[fs.FileSystem, str, str]:
        where = self.options["path"]
        if "://" not in where:
            where = where.removeprefix("file:")
            return fs.LocalFileSystem(), where, ""
        files, root = fs.FileSystem.from_uri(where)
        return files, root, where[: len(where) - len(root)] if where.endswith(root) else ""

    def partitions(self) -> list[Piece]:
        files, root, _ = self._files()
        found = files.get_file_info([root])[0]
        listed = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = {f.path: f.size for f in listed if f.is_file}
        block, out = int(self.options.get("blockBytes", 32 << 20)), []
        for path, size in sorted(sizes.items()):
            kind = path.rsplit(".", 1)[-1].lower()
            if kind not in READ + ABSENT or not self.wanted.takes("path", path):
                continue
            if kind == "vhdr":  # the samples lie elsewhere, mostly under the same name
                stem = path.rsplit(".", 1)[0]
                size = next((sizes[stem + e] for e in (".eeg", ".dat") if stem + e in sizes), -1)
                size = self._size_named(files, path) if size < 0 else size
            blocks = 1 if kind in ABSENT else max(1, -(-size // block))
            out += [Piece(path, size, k * block, (k + 1) * block if k + 1 < blocks else max(size, 1)) for k in range(blocks)]
        return out

    def _size_named(self, files: fs.FileSystem, path: str) -> int:
        try:
            return max(files.get_file_info([brainvision_layout(path, self._opened(files, path)).data])[0].size or 0, 0)
        except (KeyError, ValueError, OSError):
            return 0

    def _opened(self, files: fs.FileSystem, path: str):
        handle = files.open_input_file(path)
        size = handle.size()

        def read(at: int, n: int) -> bytes:
            n = max(min(n, size - at), 0)
            self.bytes_read += n
            return handle.read_at(n, at) if n else b""

        return read

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        files, _, _ = self._files()
        kind = piece.path.rsplit(".", 1)[-1].lower()
        try:
            if kind in ABSENT:
                raise ValueError(f"no reader for .{kind}")
            read = self._opened(files, piece.path)
            layout = (brainvision_layout if kind == "vhdr" else edf_layout)(piece.path, read)
            if layout.data != piece.path:
                read = self._opened(files, layout.data)
            if layout.record <= 0 or layout.seconds <= 0 or any(c.gain == 0 or not math.isfinite(c.gain) for c in layout.channels):
                raise ValueError("the header describes no samples")
        except (ValueError, KeyError, IndexError, ZeroDivisionError, OSError) as e:
            if piece.start == 0:
                yield pa.RecordBatch.from_pylist([{"path": piece.path, "error": f"{type(e).__name__}: {e}"}], ARROW)
            return
        records = max(piece.data_size - layout.head, 0) // layout.record
        records = records if layout.records < 0 else min(records, layout.records)
        first, end = (max(-(-(b - layout.head) // layout.record), 0) for b in (piece.start, piece.end))
        channels = [c for c in layout.channels if self.wanted.takes("channel", c.name)]
        first, end = self.wanted.records(layout, channels, first, records if piece.end >= piece.data_size else min(end, records))
        step = max(1, BATCH // max(1, sum(c.count for c in channels)))
        for at in range(first, end, step):
            n = min(step, end - at)
            for c, values in self._samples(read, layout, channels, at, n, records):
                start = at * c.count
                sfreq = c.count / layout.seconds
                number = np.arange(start, start + len(values))
                same = lambda v: pa.repeat(pa.scalar(v, pa.string()), len(values))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(piece.path), same(c.name), pa.repeat(pa.scalar(sfreq), len(values)), same(c.unit), pa.array(number), pa.array(number / sfreq), pa.array(values * c.gain + c.shift), pa.nulls(len(values), pa.string())], schema=ARROW)

    def _samples(self, read, layout: Layout, channels: list[Channel], at: int, n: int, records: int) -> Iterator[tuple[Channel, np.ndarray]]:
        """Values of each channel in n records; of one channel in large records only its own bytes are read."""
        if layout.by_channel:
            for c in channels:
                yield c, physical(read((c.at // layout.width * records + at) * layout.width, n * layout.width), layout.kind)
            return
        spans = sorted((c.at, c.at + c.count * layout.width) for c in channels)
        merged: list[list[int]] = []
        for a, z in spans:
            if merged and a - merged[-1][1] <= GAP:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        whole = len(merged) == 1 and layout.record - (merged[0][1] - merged[0][0]) <= GAP
        if whole:
            block = np.frombuffer(read(layout.head + at * layout.record, n * layout.record), np.uint8).reshape(n, layout.record)
            for c in channels:
                yield c, physical(np.ascontiguousarray(block[:, c.at : c.at + c.count * layout.width]).tobytes(), layout.kind)
            return
        parts: dict[int, list[bytes]] = {c.at: [] for c in channels}
        for k in range(at, at + n):
            for a, z in merged:
                got = read(layout.head + k * layout.record + a, z - a)
                for c in channels:
                    if a <= c.at < z:
                        parts[c.at].append(got[c.at - a : c.at - a + c.count * layout.width])
        for c in channels:
            yield c, physical(b"".join(parts[c.at]), layout.kind)


class Recordings(ds.DataSource):
    """spark.read.format("recordings").load(folder or file): a row for each sample of each channel."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SignalReader:
        return SignalReader(dict(self.options))


def read_signals(spark: SparkSession, path: str, block_bytes: int = 32 << 20) -> DataFrame:
    """path, channel, sfreq, unit, sample, time, value, error of the recordings at or below a path.

    Formats go by extension, in any case. Conditions on path, channel, sample and time of the
    returned table reach the reader (see SignalReader). Rows with an error have nothing else but the path.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").option("blockBytes", block_bytes).load(path)
