"""State tables: a folder of Parquet snapshots behind a commit pointer, rewritten bucket by bucket."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from neurospan.sinks.tables import latest

BUCKET = "_bucket"


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


class Conflict(Exception):
    """Another writer committed since the table was read; nothing was changed."""


class StateTable:
    """Rows by key, replaced atomically; keys may be null, and null equals null.

    Rows lie in buckets by hash of their key, each bucket a folder that is never changed. A commit is a
    small file, named by its number, that says which folder each bucket has, the columns, and the last batch of
    every stream that wrote. Data are written first; the commit takes its name only where no commit has it (a
    link on a local disk, a rename on HDFS; a store whose renames replace files isn't fit for several writers),
    so of two writers one gets Conflict, and a writer that dies before it leaves folders that no reader sees. A
    change rewrites only the buckets its keys fall in, as Spark jobs; the driver reads one row for each
    touched bucket.

    New columns of written rows are added, null for earlier rows; a column keeps its type. path is a
    folder that all machines share.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _place(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the last commit, 0 where there is none."""
        files, folder = self._place("_commits")
        if not files.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:-5]) for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def commit(self, version: int | None = None) -> dict:
        """What a commit says; the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "buckets": {}, "n": self.buckets, "keys": self.keys, "streams": {}}
        files, path = self._place(f"_commits/{version:012d}.json")
        stream = files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["keys"] != self.keys:
            raise ValueError(f"the table's keys are {found['keys']}")
        return found

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last by default; None before the first commit."""
        return self._rows(self.commit(version))

    def _rows(self, at: dict, only: set[int] | None = None) -> DataFrame | None:
        if at["schema"] is None:
            return None
        schema = StructType.fromJson(at["schema"])
        folders = [f"{self.path}/{f}" for b, f in at["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(n)).cast("int")

    def _write(self, at: dict, df: DataFrame, touched: set[int] | None, streams: dict | None = None) -> int:
        """Writes df as the rows of the touched buckets (all where None) and commits on top of at."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn(BUCKET, self._bucket(at["n"])).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        files, path = self._place(folder)
        names = [s.getPath().getName() for s in files.listStatus(path)]
        fresh = {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        kept = {} if touched is None else {b: f for b, f in at["buckets"].items() if int(b) not in touched}
        self._publish({**at, "version": at["version"] + 1, "schema": _nullable(df.schema).jsonValue(), "buckets": {**kept, **fresh}, "streams": {**at["streams"], **(streams or {})}})
        return at["version"] + 1

    def _publish(self, said: dict) -> None:
        files, path = self._place(f"_commits/{said['version']:012d}.json")
        _, draft = self._place(f"_drafts/{uuid.uuid4().hex}")
        try:
            # the commit appears under its name at once and whole, and never replaces one
            out = files.create(draft, False)
            out.write(bytearray(json.dumps(said).encode()))
            out.close()
            files.mkdirs(path.getParent())
            if files.getUri().getScheme() == "file":  # a rename would replace here
                os.link(draft.toUri().getPath(), path.toUri().getPath())
            elif files.exists(path) or not files.rename(draft, path):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"version {said['version']} is there already") from None
        finally:
            files.delete(draft, False)

    def replace(self, df: DataFrame, at: int | None = None) -> int:
        """All rows anew, one of each key; at is the version the caller has seen (default: the last)."""
        base = self.commit(at)
        return self._write({**base, "n": self.buckets}, self._one_of_each(df, None), None)

    def _one_of_each(self, df: DataFrame, order: str | None) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys]
        return latest(df, self.keys, [order] if order else rest or self.keys)

    def upsert(self, df: DataFrame, at: int | None = None, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """df's rows in place of those with the same keys; of df's own rows with one key the last by order stays.

        With order, a row that is there stays where df's is older. stream names a streaming query and its batch:
        a batch that was committed before is left out, so a batch that runs again changes nothing.
        """
        base = self.commit(at)
        if stream and base["streams"].get(stream[0], -1) >= stream[1]:
            return base["version"]
        new = self._one_of_each(df, order).withColumn("_new", F.lit(1))
        touched = {r[0] for r in new.select(self._bucket(base["n"])).distinct().collect()}  # buckets, not rows
        old = self._rows(base, touched)
        rows = new
        if old is not None:
            self._same_types(old, df)
            rows = latest(old.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True), self.keys, [*([order] if order else []), "_new"])
        columns = [c for c in (old.columns if old is not None else [])] + [c for c in df.columns if old is None or c not in old.columns]
        return self._write(base, rows.select(*columns), touched, {stream[0]: stream[1]} if stream else None)

    def _same_types(self, old: DataFrame, new: DataFrame) -> None:
        before, now = dict(old.dtypes), dict(new.dtypes)
        changed = {c: (before[c], now[c]) for c in now if c in before and before[c] != now[c]}
        if changed or any(k not in now for k in self.keys):
            raise ValueError(f"types of columns don't change, and keys are given: {changed}")

    def add(self, df: DataFrame, at: int | None = None) -> int:
        """df's rows, none of whose keys may be there, or twice in df: otherwise ValueError, and nothing is written."""
        base = self.commit(at)
        twice = df.groupBy(*self.keys).count().filter("count > 1")
        old = self._rows(base)
        known = twice.limit(1)
        if old is not None:
            side = old.select(*[F.col(k).alias(f"_old_{k}") for k in self.keys])
            known = twice.select(*self.keys).unionByName(df.select(*self.keys).join(side, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.keys], "left_semi")).limit(1)
        first = known.first()
        if first:
            raise ValueError(f"there already: {[first[k] for k in self.keys]}")
        return self.upsert(df, at)

    def purge(self, column: str, value: str, confirm: bool = False) -> int:
        """Without the rows of a subject, a pipeline, or another value of a key; only with confirm, and only what is there."""
        if not confirm:
            raise ValueError("confirm that the rows go")
        base = self.commit()
        old = self._rows(base)
        gone = old.filter(F.col(column) == value).select(*self.keys) if old is not None else None
        if gone is None or gone.isEmpty():
            raise ValueError(f"no rows with {column} = {value}")
        return self.delete(gone, base["version"])

    def delete(self, gone: DataFrame, at: int | None = None) -> int:
        """Without the rows whose keys gone holds; a commit of its own, also where none is there."""
        base = self.commit(at)
        gone = gone.select(*self.keys).distinct()
        touched = {r[0] for r in gone.select(self._bucket(base["n"])).distinct().collect()}
        old = self._rows(base, touched)
        if old is None:
            return base["version"]
        side = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in self.keys])
        left = old.join(side, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in self.keys], "left_anti")
        return self._write(base, left, touched)

    def change(self, step: Callable[[StateTable, int], int], tries: int = 5) -> int:
        """Runs step on the last version, and again on the next one where another writer was first."""
        for left in range(tries - 1, -1, -1):
            try:
                return step(self, self.version())
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 10) -> int:
        """Removes commits before the last keep and folders that no commit left names; their number.

        A writer that hasn't committed yet would lose its folder, so none should be at work.
        """
        last = self.version()
        files, commits = self._place("_commits")
        numbers = [n for n in range(max(1, last - keep + 1), last + 1)]
        used = {f.split("/")[1] for n in numbers for f in self.commit(n)["buckets"].values()}
        for s in files.listStatus(commits) if last else []:
            if s.getPath().getName().endswith(".json") and int(s.getPath().getName()[:-5]) < numbers[0]:
                files.delete(s.getPath(), False)
        files, data = self._place("data")
        unused = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in used] if files.exists(data) else []
        for path in unused:
            files.delete(path, True)
        return len(unused)
