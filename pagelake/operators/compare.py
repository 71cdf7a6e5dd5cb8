"""Comparing publications: profiles, ranks, similarity, events over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's numbers divided by their sum."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[F.try_divide(F.col(c), total).alias(c) for c in columns])


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def extremes(df: DataFrame, group: str, name: str, value: str, n: int = 3, largest: bool = True) -> DataFrame:
    """The n largest or smallest names of each group as one string in rank order."""
    by = F.desc(value) if largest else F.asc(value)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(by, name))
    top = df.withColumn("_nth", nth).where(F.col("_nth") <= n)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", name))), lambda s: s[name]), ", ")
    return top.groupBy(group).agg(listed.alias("names"))


def cosine_matrix(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(a, b, similarity) of all pairs of profiles given as (key, name, value).

    Profiles meet by the names they share, so this is one shuffle by name; keys
    are publications or topics, a few dozen at most.
    """
    length = df.groupBy(F.col(key).alias("k")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("len"))
    left = df.select(F.col(key).alias("a"), F.col(name).alias("n1"), F.col(value).alias("v1"))
    right = df.select(F.col(key).alias("b"), F.col(name).alias("n2"), F.col(value).alias("v2"))
    dots = left.join(right, F.col("n1") == F.col("n2")).groupBy("a", "b").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    out = dots.join(length, F.col("a") == F.col("k")).withColumnRenamed("len", "len_a").drop("k")
    out = out.join(length, F.col("b") == F.col("k")).drop("k")
    return out.select("a", "b", F.try_divide("dot", F.col("len_a") * F.col("len")).alias("similarity"))


def ward_linkage(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward's agglomeration of a small distance matrix: (cluster, cluster, height, size) per merge.

    Clusters are numbered as they arise, after the points; distances follow the
    Lance-Williams recurrence.
    """
    n = len(distances)
    d = {(i, j): float(distances[i][j]) for i in range(n) for j in range(i + 1, n)}
    size, out = {i: 1 for i in range(n)}, []
    for new in range(n, 2 * n - 1):
        (i, j), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        merged = {}
        for k in size:
            if k in (i, j):
                continue
            ik, jk = d[min(i, k), max(i, k)], d[min(j, k), max(j, k)]
            t = size[i] + size[j] + size[k]
            merged[k] = (((size[i] + size[k]) * ik**2 + (size[j] + size[k]) * jk**2 - size[k] * h**2) / t) ** 0.5
        out.append((i, j, h, size[i] + size[j]))
        d = {p: v for p, v in d.items() if i not in p and j not in p} | {(k, new): v for k, v in merged.items()}
        size = {k: s for k, s in size.items() if k not in (i, j)} | {new: size[i] + size[j]}
    return out


def per_month(df: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """Sums per calendar month, zero in months between a group's first and last without rows."""
    months = df.where(F.col(date).isNotNull()).groupBy(F.col(group).alias("_of"), F.trunc(date, "MM").alias("_month")).agg(F.sum(value).alias("total"))
    span = months.groupBy(F.col("_of").alias("_g")).agg(F.min("_month").alias("lo"), F.max("_month").alias("hi"))
    grid = span.select("_g", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("_m"))
    out = grid.join(months, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_m") == F.col("_month")), "left")
    return out.select(F.col("_g").alias(group), F.last_day("_m").alias("month_end"), F.date_format("_m", "MMMM").alias("month_name"), F.coalesce("total", F.lit(0)).alias("total"))


def mentions(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text matches, in any case."""
    return df.where(F.rlike(F.col(text), F.lit(f"(?i){pattern}")))


def total_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])
