"""From boxes to model requests: crop plans, request lines, experiment grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import ids
from pagelake.functions.geometry import clamp, split_rows

#: Instructions by box class; other classes get the one for text.
PROMPTS = {
    "text": "Transcribe the text of this image exactly. Answer with the text only.",
    "title": "Transcribe the heading of this image exactly. Answer with the text only.",
    "table": "Transcribe the table of this image as tab separated values. Answer with the table only.",
    "figure": "Describe this picture in one short paragraph.",
}


def request_plan(df: DataFrame, max_ratio: float = 1.5, overlap: float = 0.2) -> DataFrame:
    """One row per image segment of each box: crop rectangle, segment, padding at the top, custom_id.

    Figures go whole; tall boxes are split; wide boxes are padded to a square;
    boxes outside the image are left out.
    """
    df = df.withColumn("_crop", clamp(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("page_width"), F.col("page_height"))).where("_crop.valid")
    w, h = F.col("_crop.x2") - F.col("_crop.x1"), F.col("_crop.y2") - F.col("_crop.y1")
    df = split_rows(df.select("page_id", "class", "box_page_id", "_crop"), w, h, F.col("class") == "figure", max_ratio, overlap)
    pad = F.when((F.col("class") != "figure") & (h < w), F.floor((w - h) / 2)).otherwise(0).cast("int")
    return df.select(
        "page_id", "class", "box_page_id", F.col("k").alias("segment"), F.col("_crop.x1").alias("crop_x1"), F.col("_crop.x2").alias("crop_x2"),
        (F.col("_crop.y1") + F.col("y0")).alias("crop_y1"), (F.col("_crop.y1") + F.col("y1")).alias("crop_y2"), pad.alias("pad_top"),
        ids.custom_id(F.col("page_id").cast("string"), F.col("class"), F.col("box_page_id"), F.col("k")).alias("custom_id"),
    )


def _request(content: Column, max_tokens: int) -> Column:
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(F.struct("custom_id", F.struct(F.lit(max_tokens).alias("max_tokens"), F.array(message).alias("messages")).alias("body")))


def image_lines(df: DataFrame, prompts: dict[str, str] = PROMPTS, max_tokens: int = 2000) -> DataFrame:
    """One JSON request line per row of (custom_id, class, image as base64)."""
    text = F.lit(prompts["text"])
    for name, p in prompts.items():
        text = F.when(F.col("class") == name, p).otherwise(text)
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("data:image/png;base64,"), F.col("image")).alias("image_url")))
    return df.select(_request(parts, max_tokens).alias("value"))


def text_lines(df: DataFrame, prompt: str = "prompt", max_tokens: int = 2000) -> DataFrame:
    return df.select(_request(F.col(prompt), max_tokens).alias("value"))


def experiment_grid(spark: SparkSession, datasets: list[str], deskew: tuple = (True, False), ratios: tuple = (1.0, 1.5, 2.0, 1000.0)) -> DataFrame:
    """Every combination of the parameters, with the file name that carries them."""
    rows = [(d, s, float(r)) for d in datasets for s in deskew for r in ratios]
    grid = spark.createDataFrame(rows, "dataset string, deskew boolean, max_ratio double")
    name = F.concat(F.col("dataset"), F.lit("_deskew_"), F.col("deskew").cast("string"), F.lit("_max_ratio_"), F.col("max_ratio").cast("string"))
    return grid.withColumn("filename", name)


def parse_experiment(name: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(name, r"^(.*)_deskew_(true|false)_max_ratio_([0-9.]+)$", i)
    return {"dataset": part(1), "deskew": part(2) == "true", "max_ratio": part(3).try_cast("double")}


def pseudo_issues(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Number rows into batches of ``size`` by a numeric key that counts from zero."""
    return df.withColumn("issue", F.concat(F.lit("batch_"), F.floor(F.col(order) / size).cast("string")))
