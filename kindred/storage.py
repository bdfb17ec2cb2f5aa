"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that are not released, each with the thread that wrote it: queries that run at once in one session keep apart.
_TABLES: list[tuple[int, str]] = []
_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a session that runs in one process may name none: it gets a folder of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="kindred-"))
    return f"file://{_LOCAL[0].name}"


def new_table(spark: SparkSession) -> str:
    """The folder of a table that is not written yet."""
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_at_exit, spark)
    _TABLES.append((threading.get_ident(), path))
    return path


def materialise(df: DataFrame, compression: str | None = None, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, in ``session`` if one is given.

    Lineage ends there, so a lost executor costs a reread and not a recomputation, and later joins know the table's true
    size (Spark then broadcasts it only below its own threshold).
    """
    path = new_table(df.sparkSession)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if a scan of its size has fewer partitions than there are: for small tables whose rows cost more than their shuffle. Decided from the plan's estimate, no job runs."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def tables() -> list[str]:
    """The folders of the tables that this thread has written and not released."""
    return [path for thread, path in _TABLES if thread == threading.get_ident()]


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that ``materialise`` wrote (all of them without ``paths``). What still reads them must have been written before."""
    for path in tables() if paths is None else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _TABLES[:] = [x for x in _TABLES if x[1] != path]


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        release(spark, [path for _, path in _TABLES])
