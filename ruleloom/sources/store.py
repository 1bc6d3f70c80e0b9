"""Tables in the shared folder, where plans that repeat or branch end their lineage, and this package for executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: folders of tables that this session wrote and has not dropped
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, as in tests, a new one, but only for
    a master in this very process: on a cluster other machines would not see a folder of the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ruleloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; clear() deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ruleloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes the folder of a written table that nothing reads any more; other DataFrames are left alone."""
    path = getattr(df, "_ruleloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        left = _tables.get(df.sparkSession.sparkContext.applicationId, [])
        if path in left:
            left.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session's queries wrote and still keep; their results must have been read before."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Let the executors import this package where PYTHONPATH does not already lead them to it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root and spark.sparkContext.master.startswith("local["):
        return
    if not getattr(spark.sparkContext, "_ruleloom_shipped", False):
        out = shutil.make_archive(f"{tempfile.mkdtemp()}/ruleloom", "zip", root, "ruleloom")
        spark.sparkContext.addPyFile(out)
        spark.sparkContext._ruleloom_shipped = True
