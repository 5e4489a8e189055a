"""Intermediate tables under the folder that all executors share. A run, that is a driver process, has a folder of its own there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_RUN = f"codeloom-{uuid.uuid4().hex[:12]}"
_own: list[str] = []
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only on one machine, as in tests, may that be unset; then it is a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codeloom-"))
        _roots.add(f"file://{_own[0]}")
    return f"file://{_own[0]}"


def run_dir(spark: SparkSession) -> str:
    """Where this run keeps its tables; release() removes it."""
    path = f"{shared_dir(spark)}/{_RUN}"
    _roots.add(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    jvm = (sc or SparkContext)._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes a table made by save(), once nothing lazy reads it any more."""
    _delete(df._saved_at)


@atexit.register
def release() -> None:
    """Deletes all that this run has saved. Results that aren't written or collected by then can't be read any more."""
    while _roots:
        try:
            _delete(_roots.pop())
        except Exception:  # noqa: BLE001  the JVM may be gone at the end of the process
            pass
    _own.clear()
