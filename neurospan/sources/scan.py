"""What columns of event files hold: distinct values up to a bound, in one pass over all columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that name an event, most wanted first, and the number of values from which a column isn't categorical.
NAMING = ("trial_type", "Correct", "stimulus", "response", "condition", "Match")
MANY = 20
#: Values a task holds before it emits them and starts again.
HELD = 200_000


def distinct_values(df: DataFrame, key: str, columns: list[str], many: int = MANY) -> DataFrame:
    """key, column, n_distinct, values of each column by key; both null where there are many values or more.

    A task keeps up to many values of each column and key and looks no further at a column that has them; it
    emits those, so what is shuffled is bounded by tasks, keys and columns, not by rows or values. Where no
    task met many, the union of what they kept is complete. Missing values aren't values. Values are compared as text.
    """
    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], set[str]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, c, v) for (k, c), values in held.items() for v in (values or {None})], columns=["key", "column", "value"], dtype="object")

        for frame in frames:
            for k, part in frame.groupby("_key", dropna=False):
                for c in columns:
                    values = held.setdefault((k if isinstance(k, str) else None, c), set())
                    if len(values) < many:
                        for v in part[c].dropna().unique():
                            values.add(v)
                            if len(values) >= many:
                                break
            if len(held) * many > HELD:
                yield rows()
                held.clear()
        yield rows()

    text = df.select(F.col(key).cast("string").alias("_key"), *[F.col(c).cast("string").alias(c) for c in columns])
    met = text.mapInPandas(keep, "key string, column string, value string").distinct()
    by = met.groupBy("key", "column").agg(F.count("value").alias("_n"), F.collect_set("value").alias("_values"))
    few = F.col("_n") < many
    return by.select(F.col("key").alias(key), "column", F.when(few, F.col("_n")).alias("n_distinct"), F.when(few, F.sort_array("_values")).alias("values"))


def categorical_columns(df: DataFrame, key: str, columns: list[str], many: int = MANY) -> DataFrame:
    """column, categorical, files, few: candidates are columns of text, and those with fewer than many values in a file.

    files counts the keys that have a value in the column, few those with fewer than many.
    """
    texts = [c for c, kind in df.dtypes if kind == "string" and c in columns]
    found = distinct_values(df, key, columns, many)
    by = found.groupBy("column").agg(F.count_if(F.coalesce(F.col("n_distinct") > 0, F.lit(True))).alias("files"), F.count("n_distinct").alias("few"))
    return by.select("column", (F.col("column").isin(*texts) | (F.col("few") > 0)).alias("categorical"), "files", "few")


def event_names(df: DataFrame, wanted: str | None = None) -> DataFrame:
    """name, n: how often each value occurs in the first naming column that the table has (or the one wanted)."""
    column = next((c for c in ((wanted,) if wanted else NAMING) if c in df.columns), None)
    name = F.col(column).cast("string") if column else F.lit(None).cast("string")
    return df.select(name.alias("name")).dropna().groupBy("name").agg(F.count("*").alias("n"))
