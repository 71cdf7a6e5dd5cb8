"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet in
the shared folder and gives the next stage what it reads back, so that a lost
executor never costs more than the stage it was in.

Edge cases: documents with null, empty or blank texts fail the quality rules and
go there, as do all that lose too much of their text. Rows that repeat doc_id
and text are one document from the second stage on; rows of one doc_id and
different texts stay apart, and the third stage drops a doc_id only if none of
its rows is the one that stays. Long texts pass whole. Ties are broken by doc_id,
in the mix by a hash of doc_id and text. An empty table gives an empty result.
Other columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import exact_dedup, mixing, pieces, quality_rules, simhash
from pagelake.llm.common import stored
from pagelake.llm.registry import tokenizer_path
from pagelake.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    return quality_rules.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    ship(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    ship(spark)
    return pieces.encode(docs, pieces.model_bytes(spark, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Fingerprints, components and piece ids are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
