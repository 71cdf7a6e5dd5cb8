"""From nested model responses to one text per box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import ids
from pagelake.functions.knit import knit
from pagelake.functions.text import clean_text, fence_strip

SCHEMA = (
    "id string, custom_id string, response struct<body: struct<usage: struct<prompt_tokens: int, completion_tokens: int, total_tokens: int>, "
    "choices: array<struct<finish_reason: string, message: struct<content: string>>>>>"
)


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Response rows from lines of JSON; lines that do not parse are left out."""
    got = lines.where(F.trim(column) != "").select(F.from_json(F.trim(column), SCHEMA).alias("r"))
    return got.where("r.custom_id IS NOT NULL").select("r.*")


def flatten(df: DataFrame) -> DataFrame:
    first = F.try_element_at("response.body.choices", F.lit(1))
    usage = F.col("response.body.usage")
    return df.select(
        "id", "custom_id", *[usage[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        first["finish_reason"].alias("finish_reason"), first["message"]["content"].alias("content"),
    )


def decompose(df: DataFrame) -> DataFrame:
    return df.withColumns(ids.decompose(F.col("custom_id")))


def combine_segments(df: DataFrame) -> DataFrame:
    """One row per box: segments knitted in order, tokens summed, ids rebuilt. Rows without a full id are left out."""
    keys = ["issue_id", "page_number", "block", "column", "class", "reading_order"]
    parts = F.transform(F.sort_array(F.collect_list(F.struct("segment", "content"))), lambda s: s["content"])
    out = df.dropna(subset=keys).groupBy(*keys).agg(
        parts.alias("parts"), F.count(F.lit(1)).alias("segment_count"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    )
    out = out.withColumn("content", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(knit("parts"))).drop("parts")
    return out.withColumns({
        "box_page_id": ids.box_page_id(F.col("block"), F.col("column"), F.col("reading_order")),
        "page_id": F.concat("issue_id", F.lit("_page_"), F.col("page_number").cast("string")),
    })


def tidy(df: DataFrame, most_title_tokens: int = 50) -> DataFrame:
    """Fences off, long titles are text, line breaks joined outside tables."""
    df = df.withColumn("content", fence_strip(F.col("content")))
    df = df.withColumn("class", F.when((F.col("completion_tokens") > most_title_tokens) & (F.col("class") == "title"), "text").otherwise(F.col("class")))
    return df.withColumn("content", F.when(F.col("class") != "table", clean_text(F.col("content"))).otherwise(F.col("content")))
