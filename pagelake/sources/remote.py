"""Copying and deleting files in any store that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    target, conf = context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration()
    return target, target.getFileSystem(conf), conf


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern finds, in order."""
    target, store, _ = _open(spark, pattern)
    return sorted(f.getPath().toString() for f in store.globStatus(target) or [])


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Copy a file or folder; False if the target is there and may not be overwritten."""
    a, from_store, conf = _open(spark, source)
    b, to_store, _ = _open(spark, target)
    if not overwrite and to_store.exists(b):
        return False
    return bool(spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, a, to_store, b, False, overwrite, conf))


def delete(spark: SparkSession, pattern: str, page: int = 100) -> int:
    """Delete what a glob pattern finds, ``page`` paths at a time; how many were deleted."""
    gone = 0
    while found := matching(spark, pattern)[:page]:
        for path in found:
            target, store, _ = _open(spark, path)
            if not store.delete(target, True):
                raise OSError(f"{path} can't be deleted")
            gone += 1
    return gone
