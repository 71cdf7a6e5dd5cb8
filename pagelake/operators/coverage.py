"""Exact coverage and overlap of boxes on a page, without a raster.

A page's boxes are gathered once. Their left and right edges cut it into slabs;
in each slab the boxes that cross it are swept from top to bottom, with running
counts of text and figure boxes. Pages with about as many boxes are swept
together in Python, in pieces of bounded size, so there is one shuffle, time
grows with the square of a page's boxes at most, and memory with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SUMS = ["text_coverage_pixels", "text_overlap_pixels", "text_image_overlap", "total_covered_pixels", "total_overlap"]
#: Cells (slab by edge) that are held at once.
CELLS = 1_000_000


def _areas(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, fig: np.ndarray) -> np.ndarray:
    """SUMS of pages with the same number of boxes, one page a row; boxes with a = b or c = d count nothing."""
    pages, n = a.shape
    xs = np.sort(np.concatenate([a, b], 1), 1)
    ys = np.concatenate([c, d], 1)
    order = np.argsort(ys, 1, kind="stable")
    ys = np.take_along_axis(ys, order, 1)
    box = order % n
    at = lambda v: np.take_along_axis(v, box, 1)[:, None, :]
    left, right, sign = at(a), at(b), np.where(order < n, 1, -1).astype(np.int32)[:, None, :]
    text, figure = sign * ~at(fig), sign * at(fig)
    high = np.diff(ys, axis=1)[:, :, None].astype(np.float64)
    out = np.zeros((pages, 5), np.int64)
    step = max(1, CELLS // (pages * 2 * n))
    for k in range(0, 2 * n - 1, step):
        x0, x1 = xs[:, k : 2 * n - 1][:, :step], xs[:, k + 1 :][:, :step]
        crossing = (left <= x0[:, :, None]) & (x1[:, :, None] <= right)
        t, f = (np.cumsum(crossing * v, 2, dtype=np.int32)[:, :, :-1] for v in (text, figure))
        wide = (x1 - x0)[:, :, None]
        for j, cond in enumerate((t > 0, t > 1, (t > 0) & (f > 0), t + f > 0, t + f > 1)):
            heights = np.matmul(cond.astype(np.float64), high)  # whole numbers below 2 ** 53
            out[:, j] += (heights.astype(np.int64) * wide).sum((1, 2))
    return out


def _sweep(batches: Iterator) -> Iterator:
    """Replaces each page's boxes by SUMS."""
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("boxes"))
        values = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fields = [values.field(k) for k in range(5)]
        whole = np.all([f.is_valid().to_numpy(zero_copy_only=False) for f in fields], 0) if len(values) else np.zeros(0, bool)
        a, b, c, d, fig = (f.fill_null(0 if f.type != pa.bool_() else False).to_numpy(zero_copy_only=False) for f in fields)
        good = np.flatnonzero(whole & (a < b) & (c < d))
        a, b, c, d, fig, owner = (v[good] for v in (a.astype(np.int64), b.astype(np.int64), c.astype(np.int64), d.astype(np.int64), fig.astype(bool), owner))
        counts = np.bincount(owner, minlength=len(sizes))
        starts = np.cumsum(counts) - counts
        sums = np.zeros((len(sizes), 5), np.int64)
        for n in np.unique(counts[counts > 0]):
            pages = np.flatnonzero(counts == n)
            most = max(1, CELLS // (4 * n * n))
            for k in range(0, len(pages), most):
                some = pages[k : k + most]
                rows = starts[some][:, None] + np.arange(n)
                sums[some] = _areas(*(v[rows] for v in (a, b, c, d, fig)))
        kept = [(name, batch.column(i)) for i, name in enumerate(batch.schema.names) if name != "boxes"]
        yield pa.RecordBatch.from_arrays([v for _, v in kept] + [pa.array(sums[:, j]) for j in range(5)], names=[k for k, _ in kept] + SUMS)


def page_coverage(df: DataFrame) -> DataFrame:
    """One row per page from boxes with print_* columns."""
    clip = lambda c, o, m: F.least(F.greatest((F.col(c) - F.col(o)).cast("int"), F.lit(0)), F.col(m))
    box = F.struct(clip("x1", "print_x1", "print_width").alias("a"), clip("x2", "print_x1", "print_width").alias("b"), clip("y1", "print_y1", "print_height").alias("c"), clip("y2", "print_y1", "print_height").alias("d"), F.coalesce(F.col("class") == "figure", F.lit(False)).alias("fig"))
    figures = [F.max("print_height").alias("print_height"), F.max("print_width").alias("print_width"), F.min("print_x1").alias("x_min"), F.min("print_y1").alias("y_min"), F.max("print_area").alias("maximum_print_area")]
    pages = df.groupBy("page_id").agg(F.collect_list(box).alias("boxes"), *figures)
    names = [c for c in pages.columns if c not in ("page_id", "boxes")]
    sums = pages.mapInArrow(_sweep, StructType([*pages.drop("boxes").schema.fields, *[StructField(c, LongType()) for c in SUMS]]))
    out = sums.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], *SUMS)
    share = lambda c: F.bround(F.try_divide(F.col(c), F.col("maximum_print_area")), 2)
    return out.withColumns({"perc_print_area_overlap": share("total_overlap"), "perc_print_area_coverage": share("total_covered_pixels")})


def coverage_delta(raw: DataFrame, method: DataFrame) -> DataFrame:
    """Difference of the shares between a method and the raw boxes, page by page."""
    a, b = raw.alias("a"), method.alias("b")
    return a.join(b, F.col("a.page_id") == F.col("b.page_id")).select(
        F.col("a.page_id").alias("page_id"),
        (F.col("b.perc_print_area_overlap") - F.col("a.perc_print_area_overlap")).alias("overlap_diff"),
        (F.col("b.perc_print_area_coverage") - F.col("a.perc_print_area_coverage")).alias("coverage_diff"),
    )
