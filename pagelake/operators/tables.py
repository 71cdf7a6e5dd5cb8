"""Joins, selections and samples of plain tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pagelake.operators.labels import hash_order


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all columns that both have; raises ValueError if there is none."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return a.join(b, shared)


def join_aggregates(a: DataFrame, b: DataFrame, keys: list[str], of_a: list[Column], of_b: list[Column]) -> DataFrame:
    """Two tables, each aggregated by the same keys, side by side; keys that only one has are left out."""
    return a.groupBy(*keys).agg(*of_a).join(b.groupBy(*keys).agg(*of_b), keys)


def count_pivot(df: DataFrame, index: str, columns: str, values: list) -> DataFrame:
    """Rows per index and column value; null where there are none."""
    return df.groupBy(index).pivot(columns, values).agg(F.count(F.lit(1)))


def side_by_side(a: DataFrame, b: DataFrame, index: list[str]) -> DataFrame:
    """Columns of both tables by a shared index; what one lacks is null. Names that clash get the suffix ``_2``."""
    renamed = {c: f"{c}_2" for c in b.columns if c in a.columns and c not in index}
    return a.join(b.withColumnsRenamed(renamed), index, "full")


def columns_like(df: DataFrame, pattern: str, keep: bool = True) -> DataFrame:
    """The columns whose names the pattern finds, or all others."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if bool(re.search(pattern, c)) is keep])


def numeric_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, NumericType)])


def rows_between(df: DataFrame, order: list, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (excluded) of an order, as a slice of a list; only ``stop`` rows of each task meet."""
    return df.orderBy(*order).offset(start).limit(max(0, stop - start))


def page_sample(df: DataFrame, key: str, n: int, seed: int = 1850) -> DataFrame:
    """The rows of n keys, such as pages, the same ones every time."""
    chosen = df.select(F.col(key).alias("_k")).distinct().orderBy(hash_order(F.col("_k"), seed), "_k").limit(n)
    return df.join(F.broadcast(chosen), F.col(key) == F.col("_k"), "left_semi")
