"""Mixing sources to target weights by weighted fair queueing, with DataFrame expressions only.

Each source is a queue of its documents in a fixed shuffled order (a hash of
doc_id and text), which may be played ``max_epochs`` times. A copy of a document
is served at the virtual time (tokens its source has sent, up to the copy's
middle) / weight. All copies of all sources are range-sorted by that time, and
the mix is what comes before the running total of their sizes reaches the
budget. Queues that run dry stop sending, which shares their excess out by
weight, so each source gets near min(weight * T, max_epochs * size) for one T:
its target, which :func:`targets` works out from the source totals alone.

The time is that of a copy's middle, not of its end, so that the cut rounds
every source to its nearest document instead of down; for the same reason a copy
across the budget is taken if at least half of it lies before it.

Prefix sums over a source never put it in one task: a document's hash puts it
into one of ``slices`` equal slices; sums per (source, slice) give each slice
its start, and a window runs within one slice only. The global order is cut by
running totals over range partitions. Only the sources themselves, one row each,
meet in one task; more than ``MAX_SOURCES`` raise an error.

Edge cases: null texts have size 0; null sources are one source, the last;
empty tables give empty results; sources of size 0 have target 0 and their
documents taken 0. Rows that repeat a doc_id are separate documents of the mix,
told apart by their text; rows that repeat both are alike and interchangeable.
Null doc_ids sort first. A text longer than its source's target is taken if half
of it fits. Input rows travel as one struct, so no column's name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import checkpointed, dropped, stored, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SLICES_PER_PARTITION = 4
MAX_SOURCES = 1_000_000


def targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, weight, target. ``totals`` has one row per source, and so has every window here."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    rows = totals.select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("most"))
    dry_first = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = dry_first.rowsBetween(Window.unboundedPreceding, -1)
    from_here = dry_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # T if this source and all after it still send: the rest of the budget over their weights.
    left = (total * budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    rows = rows.withColumn("left", left).withColumn("dry", F.col("most") <= F.col("weight") * F.col("left"))
    end = F.max(F.when(~F.col("dry"), F.col("left"))).over(Window.partitionBy())
    goal = F.when(F.col("dry") | end.isNull(), F.col("most")).otherwise(F.col("weight") * end)
    return rows.select("source", "source_size", "weight", goal.alias("target"))


def _keys(df: DataFrame, doc_id: str, text: str, source: str, size: Column | None, seed: str) -> DataFrame:
    """row, source, id, size, h (the place in the shuffled order) and x, which tells rows of one id apart."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    name = F.concat(F.lit(seed), F.coalesce(F.col("row")[doc_id].cast("string"), F.lit("")), F.md5(body))
    return rows.select(
        "row", F.col("row")[source].alias("source"), F.col("row")[doc_id].alias("id"), (word_count(F.col("row")[text]) if size is None else size).alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"), F.xxhash64(body).alias("x"),
    )


def _sent(rows: DataFrame, starts: DataFrame, slices: int) -> DataFrame:
    """Add source_size, weight, target and ``sent``: the tokens of a document's source up to and including it."""
    rows = rows.withColumn("slice", _slice(slices))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))).drop("s_source", "s_slice")
    inside = Window.partitionBy("source", "slice").orderBy("h", "id", "size", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("sent", F.col("start") + F.sum("size").over(inside)).drop("start", "slice")


def _slice(slices: int) -> Column:
    return F.floor(F.col("h").cast("double") / float(1 << 60) * slices)


def _time(epoch: Column) -> Column:
    """Virtual time at which half of a copy is sent, doubled."""
    return (2 * (F.col("sent") + epoch * F.col("source_size")) - F.col("size")).cast("double") / F.col("weight")


ORDER = ("time", "h", "id", "size", "x", "epoch")


def _end(sent: DataFrame, max_epochs: int, budget: float) -> tuple | None:
    """The place, in ORDER, of the last copy that the mix takes; None if it takes none.

    All copies are range-sorted, and running totals go from partition to
    partition, of which the driver sees one number each.
    """
    copies = sent.where("size > 0").select("sent", "source_size", "weight", "h", "id", "size", "x", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.select(_time(F.col("epoch")).alias("time"), *ORDER[1:])
    ranged = copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ranged = stored(ranged.select(*ORDER, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "mix-order")
    sizes = ranged.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()  # a row per partition
    total, before, starts = sum(r.n for r in sizes) / max_epochs * budget, 0, []
    for r in sizes:
        if before <= total:
            starts.append((r.part, before))
        before += r.n
    place = None
    for part, start in reversed(starts[-2:]):  # the mix ends in the last partition that begins before the budget, or right before it
        upto = F.lit(start) + F.sum("size").over(Window.partitionBy("part").orderBy("nth"))
        taken = ranged.where(F.col("part") == part).withColumn("upto", upto).where(2.0 * F.col("upto") - F.col("size") <= 2.0 * total)
        place = place or taken.orderBy(F.col("nth").desc()).select(*ORDER).first()
    dropped(ranged)
    return tuple(place) if place else None


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
         weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = "mix", carry: bool = True) -> DataFrame:
    """One row per document: ``row`` (its columns, if they are to be carried), id, size, source_size, target, copies, virtual_finish."""
    slices = SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keys(df, doc_id, text, source, size, seed)
    narrow = stored(rows.drop("row"), "mix-documents")
    sums = narrow.groupBy("source", _slice(slices).alias("slice")).agg(F.sum("size").alias("n"))
    totals = checkpointed(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = targets(totals, weights, budget, max_epochs)
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)))
    starts = starts.alias("a").join(goals.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select(
        F.col("a.source").alias("s_source"), F.col("a.slice").alias("s_slice"), "start", "source_size", "weight", "target"
    )
    starts = checkpointed(starts)
    place = _end(_sent(narrow, starts, slices), max_epochs, budget)
    rows = _sent(rows if carry else narrow, starts, slices)
    copies = F.lit(0)
    if place:
        last = F.struct(*[F.lit(v).cast(rows.schema[c].dataType if c in rows.columns else kind).alias(c) for (c, kind), v in zip(_KINDS, place, strict=True)])
        for epoch in range(max_epochs):
            this = F.struct(_time(F.lit(epoch)).alias("time"), *ORDER[1:-1], F.lit(epoch).alias("epoch"))
            copies = copies + F.when(this <= last, 1).otherwise(0)
    return rows.select(
        *["row"] * carry, "id", "h", "x", "size", "source_size", "weight", "target", "sent",
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), (F.col("sent") / F.col("weight")).alias("virtual_finish"),
    )


_KINDS = tuple(zip(ORDER, ("double", "long", "long", "long", "long", "int"), strict=True))


def mixed(df: DataFrame, max_epochs: int = MAX_EPOCHS, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the order of the truncated queue."""
    rows = plan(df, max_epochs=max_epochs, **options).where("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("time", _time(F.col("epoch")))
    return rows.orderBy(*ORDER).select(*[F.col("row")[c].alias(c) for c in df.columns])
