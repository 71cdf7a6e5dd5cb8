"""Geometry of boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vertical_overlap(y1: Column, y2: Column, z1: Column, z2: Column) -> Column:
    """Shared height in percent of the smaller box; 0 where they do not overlap."""
    shared = F.least(y2, z2) - F.greatest(y1, z1)
    return F.when(shared <= 0, 0.0).otherwise(F.try_divide(shared, F.least(y2 - y1, z2 - z1)) * 100)


def hull(a: Column, b: Column) -> Column:
    """Struct x1, y1, x2, y2, center_x, center_y of two boxes together."""
    x1, x2 = F.least(a["x1"], b["x1"]), F.greatest(a["x2"], b["x2"])
    y1, y2 = F.least(a["y1"], b["y1"]), F.greatest(a["y2"], b["y2"])
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x1 + x2) / 2).alias("center_x"), ((y1 + y2) / 2).alias("center_y"))


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Struct of the crop rectangle in whole pixels inside the image, and whether anything is left."""
    a, b = F.greatest(F.lit(0), x1.cast("int")), F.greatest(F.lit(0), y1.cast("int"))
    c, d = F.least(width.cast("int"), x2.cast("int")), F.least(height.cast("int"), y2.cast("int"))
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), ((c > a) & (d > b)).alias("valid"))


def _cut(width: Column, max_ratio: float, overlap: float) -> tuple[Column, Column]:
    size = F.floor(width * max_ratio).cast("int")
    return size, size - F.floor(size * overlap).cast("int")


def split_count(width: Column, height: Column, max_ratio: float = 1.5, overlap: float = 0.2, most: int = 20) -> Column:
    """Segments until one reaches the bottom, at most ``most``; null where the image stays whole."""
    size, step = _cut(width, max_ratio, overlap)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((height - size) / step).cast("int") + 1))
    return F.when((height / width <= max_ratio) | (step <= 0), F.lit(None)).otherwise(n)


def segment(k: Column, width: Column, height: Column, max_ratio: float = 1.5, overlap: float = 0.2) -> tuple[Column, Column]:
    """y0 and y1 of segment ``k`` of a tall image, the last one shifted up to keep its height."""
    size, step = _cut(width, max_ratio, overlap)
    y0 = F.when(k * step + size > height, F.greatest(F.lit(0), height - size)).otherwise(k * step)
    return y0.cast("int"), F.least(k * step + size, height).cast("int")


def split_plan(width: Column, height: Column, max_ratio: float = 1.5, overlap: float = 0.2, most: int = 20) -> Column:
    """Array of (k, y0, y1): the segments of a tall image."""
    n = split_count(width, height, max_ratio, overlap, most)

    def one(k: Column) -> Column:
        y0, y1 = segment(k, width, height, max_ratio, overlap)
        return F.struct(k.alias("k"), y0.alias("y0"), y1.alias("y1"))

    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("y0"), height.cast("int").alias("y1")))
    return F.when(n.isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def split_rows(df: DataFrame, width: Column, height: Column, whole: Column | None = None, max_ratio: float = 1.5, overlap: float = 0.2, most: int = 20) -> DataFrame:
    """``split_plan`` with one row per segment and columns k, y0, y1: only k is exploded, the rest are plain expressions."""
    n = split_count(width, height, max_ratio, overlap, most)
    n = n if whole is None else F.when(whole, F.lit(None)).otherwise(n)
    rows = df.withColumns({"_w": width, "_h": height, "_n": n}).select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)).alias("k"))
    y0, y1 = segment(F.col("k"), F.col("_w"), F.col("_h"), max_ratio, overlap)
    tall = F.col("_n").isNotNull()
    return rows.withColumns({"y0": F.when(tall, y0).otherwise(0), "y1": F.when(tall, y1).otherwise(F.col("_h").cast("int"))}).drop("_w", "_h", "_n")


def pixels_to_dpi(pixels: Column, points: Column) -> Column:
    """Dots per inch of an embedded image on a page measured in points, two decimals."""
    return F.bround(F.try_divide(pixels, points) * 72, 2)


def image_metadata(df: DataFrame) -> DataFrame:
    """Add dots per inch and aspect ratios to rows of embedded images: pdf_width, pdf_height (pixels), page_width_pt, page_height_pt."""
    ratio = lambda a, b: F.bround(F.try_divide(F.col(a), F.col(b)), 3)
    return df.withColumns({
        "calculated_width_dpi": pixels_to_dpi(F.col("pdf_width"), F.col("page_width_pt")), "calculated_height_dpi": pixels_to_dpi(F.col("pdf_height"), F.col("page_height_pt")),
        "image_aspect_ratio": ratio("pdf_width", "pdf_height"), "page_aspect_ratio": ratio("page_width_pt", "page_height_pt"), "image_format": F.lit("assume png"),
    })
