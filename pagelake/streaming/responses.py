"""An extension: response files as a stream, each micro-batch through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.operators import responses


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of flat segment rows from line-wise response files as they arrive."""
    return responses.decompose(responses.flatten(responses.decode(spark.readStream.text(path))))


def write_segments(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Append segments to Parquet, exactly once; with ``once`` it stops when all present files are read."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
