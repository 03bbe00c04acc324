"""Tables written between stages, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir.

    Where that is unset, a local master, which has one machine, uses a temporary folder, and a cluster
    the warehouse if that names a file system; a warehouse on the machines' own disks is refused.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and context.master.split("[")[0] == "local":
            base = f"file://{tempfile.mkdtemp(prefix='neurospan-')}"
        elif not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in base or base.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        _FOLDERS[app] = folder = f"{base.rstrip('/')}/neurospan-{app}"
        atexit.register(_remove, spark, folder)
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: lineage ends there, and a lost executor costs the reading stage only."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
