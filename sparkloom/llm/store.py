"""Shared storage for intermediate tables: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sparkloom.shipping import ship

_own: dict[str, str] = {}
#: The setting of how many bytes Spark sends a worker at once, and what small_batches() puts there: a little less than
#: the 4 MiB that steps take.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = 15 << 18


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset and driver and
    executors are one process. On a cluster a folder that all see must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    ship(spark)
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


#: The paths of the innermost scope of this thread (or other context), if there is one.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within, but for those to keep, are dropped at the end: nothing may read them later."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            drop(spark, path)


def write(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> str:
    """Writes a table into the shared folder and returns its path."""
    path = new_path(df.sparkSession, name)
    paths = _scope.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    return path


def saved(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """The table, written and read again: its lineage ends here and its size is known to the planner."""
    path = write(df, name, compression, keep)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Has Spark send workers a few MiB of rows at once from now on, unless the session says how many. By default
    it is 64 MiB, which a batch of whole texts comes near to: a task of any stage holds that in Spark and in its
    worker, and an executor's pools keep it. Results are the same."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that are no longer reachable."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
