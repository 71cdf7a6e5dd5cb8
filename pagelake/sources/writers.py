"""Writing results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: str | None = "periodical") -> None:
    """Overwrite with a folder per publication; Spark's committer makes files appear only when complete."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def lines(df: DataFrame, path: str) -> None:
    """Rows of one string column as lines of text, such as JSON requests."""
    df.write.mode("overwrite").text(path)


def exists(df_or_spark, path: str) -> bool:
    """Whether a path is there, in any store Spark knows; for steps that skip what is done."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written only if it is not there whole already."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def encoded_images(df: DataFrame, folder: str, name: str = "custom_id", image: str = "image") -> None:
    """Write base64 images as ``folder``/<name>.png; the folder must be one that all executors share."""

    def put(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{root}/{r[0]}.png") as f:
                f.write(bytes(r[1]))

    df.select(name, F.unbase64(image)).foreachPartition(put)
