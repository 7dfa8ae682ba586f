"""Intermediate tables of one run, in the folder that the cluster names in ``spark.checkpoint.dir``.

A staged table ends lineage: a lost executor costs a re-read, not a re-run. Without that setting a
temporary folder serves where everything runs on one machine (as in tests); elsewhere it is an error,
as executors would write to disks that the others cannot read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}
_staged: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table of one run, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    _left[path.rpartition("/")[0]] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _left.items():
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the cluster's own clean-up remains
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[back] = path.rpartition("/")[0]
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete staged tables that no plan still to run reads; other frames are left alone."""
    for frame in frames:
        if frame is not None and (path := _staged.pop(frame, None)):
            remove(_left.pop(path), path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any longer.

    Its cleaner follows the driver's garbage collection, which may else not come before the disks are
    full; call it once after a shuffle that is large beside the input.
    """
    spark.sparkContext._jvm.System.gc()
