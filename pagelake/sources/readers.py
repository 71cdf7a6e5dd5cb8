"""Reading the inputs, all lazily and with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import responses

ANNOTATION = (
    "data_row struct<external_id: string>, media_attributes struct<height: int, width: int>, "
    "projects map<string, struct<labels: array<struct<annotations: struct<objects: array<struct<name: string, "
    "bounding_box: struct<left: double, top: double, width: double, height: double>>>>>>>>"
)


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def tagged_parquet(spark: SparkSession, path: str, tag: str = "file") -> DataFrame:
    """All files of a folder, each row with its file's name without extension."""
    df = spark.read.parquet(path)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias(tag))


def union_methods(frames: dict[str, DataFrame], tag: str = "method") -> DataFrame:
    """Tables of several methods one under the other, with the method's name; missing columns are null."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def json_array(spark: SparkSession, path: str, schema: str = responses.SCHEMA) -> DataFrame:
    """Files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def response_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-wise responses; lines that do not parse are left out."""
    return responses.decode(spark.read.text(path))


def boxes_of(rows: DataFrame) -> DataFrame:
    """Boxes of annotation rows: the first project's first label set."""
    objects = F.map_values("projects")[0]["labels"][0]["annotations"]["objects"]
    rows = rows.select(F.col("data_row.external_id").alias("filename"), "media_attributes.height", "media_attributes.width", F.explode(objects).alias("o"))
    box = F.col("o.bounding_box")
    return rows.select(
        "filename", "height", "width", F.col("o.name").alias("class"), box["left"].alias("x1"), box["top"].alias("y1"),
        (box["left"] + box["width"]).alias("x2"), (box["top"] + box["height"]).alias("y2"), F.lit(1).alias("confidence"),
        F.replace(F.col("filename"), F.lit(".png"), F.lit("")).alias("page_id"),
    )


def annotated_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of line-wise annotation files."""
    return boxes_of(spark.read.schema(ANNOTATION).json(path))


def text_folder(spark: SparkSession, path: str, column: str = "content") -> DataFrame:
    """(file_name without extension, whole text) of a folder's .txt files."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("file_name"), F.col("value").alias(column))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, base64 content) of image files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select("path", F.base64("content").alias("image"))
