"""What several operators of this subpackage share: word rules and shared storage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks between words, as a regular-expression class body.
BLANKS = r"\x20\x09-\x0D"
#: The same six characters, literally.
BLANK_CHARS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where they are one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jsc.isDefined() and not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = jsc.get() if jsc.isDefined() else tempfile.mkdtemp(prefix="pagelake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage durably: a lost executor costs no recomputation of what
    came before. The files go when the driver's JVM ends, or with :func:`dropped`.
    The driver collects its garbage, upon which Spark removes the shuffle files
    that nothing refers to any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    gc.collect()
    jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small rows whose partition order matters."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
