"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str, int]] = []  # with the thread that wrote it


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if all runs on this machine in one process, else an error:
    what an executor wrote to its own disk no other would find."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given:
        there = context._jsc.sc().getCheckpointDir()
        given = there.get() if there.isDefined() else None
    if not given:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, removed when the process ends if not before."""
    path = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path, threading.get_ident()))
    return path


def materialise(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder, in that many files if given, and read it again."""
    path = new_path(df.sparkSession, label)
    (df.repartition(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for table in tables:
        drop_written(table.sparkSession, {table._written_to})


def written() -> set[str]:
    """What this thread has written and not removed; other threads may be at work on theirs."""
    return {path for _, path, thread in _WRITTEN if thread == threading.get_ident()}


def drop_written(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        remove(spark, path)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] not in paths]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_written() -> None:
    for spark, path, _ in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the cluster clears its checkpoint folder
            return
