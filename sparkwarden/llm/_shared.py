"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session, path and thread of each table that was written and isn't deleted yet.
_written: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwarden-"))
    return sc.getCheckpointDir().rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold at most 2,000 rows (10,000 is usual), so that batches of whole texts stay small in Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/sparkwarden/{uuid.uuid4().hex}-{name}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, threading.get_ident()))
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows of df, written once as Parquet and read back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sw_path = path
    return out


def mark() -> int:
    """A point in time for `discard`."""
    return len(_written)


def discard(since: int, *kept: DataFrame) -> None:
    """Delete the tables that this thread wrote since a mark, but those of `kept`: nothing that is used later may depend on the others.

    Files of shuffles that only they needed go too.
    """
    names, spark = {df._sw_path for df in kept}, None
    for entry in _written[since:]:
        if entry[2] == threading.get_ident() and entry[1] not in names:
            spark = entry[0]
            _delete(spark, entry[1])
            _written.remove(entry)
    if spark is not None:
        forget_shuffles(spark)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan refers to any more, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _clean() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session may be gone; the folder is the cluster's to purge then
            continue
