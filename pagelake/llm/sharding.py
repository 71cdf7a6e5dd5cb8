"""Sharding along a Hilbert curve, with DataFrame expressions only.

Several metadata dimensions are quantised to equal-count steps, each row gets
its cell's index on the Hilbert curve through the grid, rows are range-sorted
by that index, and the order is cut into runs. Neighbours on the curve are
neighbours in every dimension, so each shard covers a small box and min/max
statistics prune shards for filters on any of the dimensions.

A dimension is any sortable column. Its steps are exact: distinct values are
counted and range-sorted, and the ones at which the running count passes a
step's share of the rows, fewer than 2 ** ``bits``, become the cuts. A row's step
is the number of cuts below its value, by the values' own order.

The law is ``rows``: shard sizes are at most one row apart. A row's global
position comes from its place in its range partition plus the sizes of those
before, so no step holds more than one partition; ties on the curve (rows with
equal metadata, however many) are ordered by doc_id, then by their content, and
so split by the ranges. Reruns agree.

Edge cases: null dimensions take the lowest step; null texts are empty; rows
that repeat a doc_id get places of their own; an empty table gives no rows.
With fewer rows than shards some shards stay empty. Texts take no part, however
long. Columns may have any name, since input rows travel as one struct; the
result's shard, slot and hilbert stand beside them.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import stored

BITS = 5
SHARDS = 40


def cuts(values: DataFrame, steps: int) -> list:
    """Of the one column ``v``: the values at which the running count passes k / steps of the rows, once for each k below ``steps``."""
    counts = values.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "shard-values")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    if not sizes:
        return []
    ranged, total = _with_start(ranged, sizes)
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    share = lambda c: F.floor((c * F.lit(steps)).cast("decimal(38,0)") / F.lit(total).cast("decimal(20,0)"))
    passed = ranged.withColumn("upto", upto).select("v", share(F.col("upto")).alias("now"), share(F.col("upto") - F.col("n")).alias("before"))
    rows = passed.where("now > before").orderBy("v").collect()  # at most one per step
    return [r.v for r in rows for k in range(int(r.before) + 1, int(r.now) + 1) if k < steps]


def _with_start(ranged: DataFrame, sizes: list) -> tuple[DataFrame, int]:
    """Add ``start``, the rows in the partitions before, and give the rows of all."""
    rows, total = [], 0
    for part, n in sizes:
        rows.append((part, total))
        total += n
    starts = ranged.sparkSession.createDataFrame(rows, "p int, start long")  # a row per partition
    return ranged.join(F.broadcast(starts), F.col("part") == F.col("p")).drop("p"), total


def step(value: Column, found: list, kind) -> Column:
    """The number of cuts below a value; 0 for null."""
    if not found:
        return F.lit(0).cast("long")
    below = F.filter(F.array(*[F.lit(x).cast(kind) for x in found]), lambda x: x < value)
    return F.when(value.isNull(), 0).otherwise(F.size(below)).cast("long")


def with_hilbert(df: DataFrame, cells: list[str], bits: int, name: str = "hilbert") -> DataFrame:
    """Replace the cell columns (longs below 2 ** bits) by their index on the Hilbert curve.

    Every step is a projection of its own, so that no expression is written out twice.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cells]
    bit = lambda c, k: c.bitwiseAND(F.lit(1 << k)) != 0
    low = lambda k: F.lit((1 << k) - 1).cast("long")
    zero = F.lit(0).cast("long")

    def put(new: dict[str, Column]) -> None:
        nonlocal df
        df = df.select(*rest, *[new.get(c, F.col(c)).alias(c) for c in cells])

    head = cells[0]
    for k in range(bits - 1, 0, -1):
        put({head: F.col(head).bitwiseXOR(F.when(bit(F.col(head), k), low(k)).otherwise(zero))})
        for c in cells[1:]:
            swap = F.when(bit(F.col(c), k), zero).otherwise(F.col(head).bitwiseXOR(F.col(c)).bitwiseAND(low(k)))
            put({head: F.col(head).bitwiseXOR(F.when(bit(F.col(c), k), low(k)).otherwise(swap)), c: F.col(c).bitwiseXOR(swap)})
    for a, b in zip(cells, cells[1:], strict=False):
        put({b: F.col(b).bitwiseXOR(F.col(a))})
    turn = zero
    for k in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(bit(F.col(cells[-1]), k), low(k)).otherwise(zero))
    df = df.select(*rest, *[F.col(c) for c in cells], turn.alias("_turn"))
    df = df.select(*rest, *[F.col(c).bitwiseXOR(F.col("_turn")).alias(c) for c in cells])
    places = [(c, k) for k in range(bits - 1, -1, -1) for c in cells]
    parts = [F.shiftleft(F.shiftright(F.col(c), k).bitwiseAND(F.lit(1)), len(places) - 1 - i) for i, (c, k) in enumerate(places)]
    return df.select(*rest, functools.reduce(lambda a, b: a.bitwiseOR(b), parts).alias(name))


def shard(df: DataFrame, dims: dict[str, Column], shards: int = SHARDS, bits: int = BITS, doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``df`` plus shard, slot and hilbert; keep long texts out of ``df``, they would travel along."""
    names = [f"d{i}" for i in range(len(dims))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[d.alias(n) for n, d in zip(names, dims.values(), strict=True)])
    rows = stored(rows, "shard-rows")
    found = [step(F.col(n), cuts(rows.select(F.col(n).alias("v")), 1 << bits), rows.schema[n].dataType).alias(n) for n in names]
    placed = with_hilbert(rows.select("row", *found), names, bits)
    order = ["hilbert", F.col("row")[doc_id], F.xxhash64("row")]
    ranged = placed.repartitionByRange("hilbert", F.col("row")[doc_id]).sortWithinPartitions(*order)
    ranged = ranged.select("row", "hilbert", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    ranged = stored(ranged, "shard-order")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    if not sizes:
        return df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("hilbert")).where("false")
    ranged, total = _with_start(ranged, sizes)
    rank, n = F.col("rank"), F.lit(total).cast("decimal(20,0)")
    # shard k holds the ranks from ceil(k * n / shards) on
    number = F.floor(rank.cast("decimal(20,0)") * shards / n).cast("int")
    first = F.ceil(F.col("shard").cast("decimal(20,0)") * n / shards).cast("long")
    out = ranged.select("row", "hilbert", (F.col("start") + F.col("nth")).alias("rank"))
    out = out.select("row", "hilbert", "rank", number.alias("shard"))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], "shard", (rank - first).alias("slot"), "hilbert")


def write_shards(df: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write whole documents as one folder per shard, in slot order. doc_id must be unique.

    ``shard`` becomes the folders' name, so a column of that name in ``df`` is not written.
    """
    key, at = f"id_{uuid.uuid4().hex}", f"slot_{uuid.uuid4().hex}"
    out = df.drop("shard").join(placed.select(F.col(doc_id).alias(key), "shard", F.col("slot").alias(at)), F.col(doc_id) == F.col(key)).drop(key)
    out.repartitionByRange("shard", at).sortWithinPartitions("shard", at).drop(at).write.partitionBy("shard").parquet(path)
