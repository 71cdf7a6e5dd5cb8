"""Exact dedup: skew-safe combining with DataFrame expressions only.

Three stages of aggregation, each grouping by the digest *and* the full text,
so that equal digests of different texts never merge:

1. local: the partial aggregate of the first exchange collapses the copies that
   one task reads;
2. salted: the local winners of a digest are spread over ``salts`` groups;
3. global: at most ``salts`` winners per text are combined.

A text that fills a third of the table therefore reaches any one task as a few
rows. Only the last join, from documents to their group, moves a row per
document, without texts; both its sides are plain exchanges, which adaptive
execution splits where a digest is hot.

Edge cases: null texts count as empty and equal each other and "". Of equal
texts the row with the largest doc_id stays (null ids are smallest; if all
are null, keep_id is null and one row stays). Rows that repeat
both id and text are one document: they count in group_size and give one result
row. Long texts are compared whole. Input rows travel as one struct, so no
column's name can clash. An empty table gives an empty result. Two texts with one SHA-256 digest
raise an error instead of merging silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import stored

SALTS = 16


def _identity(text: Column) -> Column:
    return text


def _keyed(df: DataFrame, text: str, normalise, salts: int) -> DataFrame:
    body = normalise(F.coalesce(F.col("row")[text], F.lit("")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.select(
        "row", body.alias("body"), F.sha2(body, 256).alias("digest"), (F.spark_partition_id() % salts).alias("salt")
    )


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=_identity, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size (the text itself is dropped)."""
    keyed = _keyed(df.select(doc_id, text), text, normalise, salts).withColumn("id", F.col("row")[doc_id])
    salted = keyed.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.select("digest", "keep_id", "group_size")


def annotate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=_identity, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    winners = stored(groups(df, doc_id, text, normalise, salts), "exact-groups")
    texts = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if texts.take(1):
        raise ValueError("two different texts share one SHA-256 digest")
    docs = (
        _keyed(df.select(doc_id, text), text, normalise, salts)
        .groupBy(F.col("row")[doc_id].alias("id"), F.col("digest").alias("sha"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    docs = docs.select("id", "sha")
    joined = docs.join(winners, docs.sha == winners.digest)
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=_identity, salts: int = SALTS) -> DataFrame:
    """The rows that stay, whole: for each distinct text that with the largest doc_id.

    Rows equal in id and text are told apart by their other columns' text form,
    and where those are equal too, either stays. No join: the row rides along
    with the three stages as an aggregate value.
    """
    identity = normalise is _identity
    carried = [c for c in df.columns if not (identity and c == text)]
    others = [c for c in df.columns if c not in (doc_id, text)]
    keyed = _keyed(df, text, normalise, salts)
    field = lambda c: F.col("row")[c]
    keyed = keyed.select(
        "digest", "salt", "body",
        F.struct(field(text).isNull().alias("_null"), *[field(c).alias(c) for c in carried]).alias("slim"),
        F.struct(field(doc_id).alias("id"), F.to_json(F.struct(F.lit(0), *[field(c).alias(f"c{i}") for i, c in enumerate(others)])).alias("o")).alias("ord"),
    )
    best = [F.max_by("slim", "ord").alias("slim"), F.max("ord").alias("ord")]
    merged = keyed.groupBy("digest", "salt", "body").agg(*best).groupBy("digest", "body").agg(*best)
    back = F.when(~F.col("slim")["_null"], F.col("body"))
    return merged.select(*[(back if identity and c == text else F.col("slim")[c]).alias(c) for c in df.columns])
