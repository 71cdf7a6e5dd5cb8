"""Vectors and model outputs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def round_half_away(c: Column, digits: int) -> Column:
    """Rounded as by C and DuckDB, from the scaled number and with its sign: -0.0 for small negative ones, where ``round`` gives 0.0."""
    near = F.round(c * 10.0**digits, 0) / 10.0**digits
    return F.when((near == 0) & (c < 0), F.lit(-0.0)).otherwise(near)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / _sum(e))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def multi_label(a: Column, least: float = 0.5) -> Column:
    """0/1 per logit by its sigmoid."""
    return F.transform(a, lambda x: (sigmoid(x) > least).cast("int"))
