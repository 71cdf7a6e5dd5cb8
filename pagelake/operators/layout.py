"""Page layout: from detected boxes to columns, blocks, reading order and merged boxes.

Input boxes have page_id, filename, class, confidence, x1, y1, x2, y2 and a
box_id that breaks ties. All windows are per page, so the whole chain needs one
shuffle by page_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import ids
from pagelake.functions.geometry import vertical_overlap

def by_page():
    return Window.partitionBy("page_id")


KEPT_CLASSES = ("figure", "table", "text", "abandon")


def normalise_class(df: DataFrame) -> DataFrame:
    return df.withColumn("class", F.when(F.col("class") == "plain text", "text").otherwise(F.col("class")))


def collapse_class(df: DataFrame, other: str = "title") -> DataFrame:
    return df.withColumn("class", F.when(F.col("class").isin(*KEPT_CLASSES), F.col("class")).otherwise(other))


def print_area(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"print_{c}": f(c).over(by_page()) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))})
    df = df.withColumns({"print_height": (F.col("print_y2") - F.col("print_y1")).cast("int"), "print_width": (F.col("print_x2") - F.col("print_x1")).cast("int")})
    return df.withColumn("print_area", F.col("print_height").cast("long") * F.col("print_width").cast("long"))


def basic_box_data(df: DataFrame) -> DataFrame:
    """Sizes, the page's text width and its columns. Note: center_x is x2 and center_y is y2 until boxes are merged."""
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    df = df.withColumns({"width": width, "height": height})
    df = df.withColumns({"ratio": F.try_divide("height", "width"), "center_x": F.col("width") + F.col("x1"), "center_y": F.col("height") + F.col("y1")})
    df = print_area(df.withColumn("median_box_width", F.median(F.when(F.col("class") == "text", F.col("width"))).over(by_page())))
    df = df.withColumn("column_counts", F.floor(F.try_divide("print_width", "median_box_width")).cast("double"))
    return df.withColumn("column_width", F.try_divide("print_width", "column_counts"))


def reclassify_abandon(df: DataFrame, top_fraction: float = 0.1) -> DataFrame:
    high = (F.col("class") == "abandon") & (F.col("y1") <= F.col("print_y1") + top_fraction * F.col("print_height"))
    df = df.withColumn("abandon_line", F.max(F.when(high, F.col("y2"))).over(by_page()))
    return df.withColumn("class", F.when(F.col("center_y") <= F.col("abandon_line"), "abandon").otherwise(F.col("class")))


def drop_abandon(df: DataFrame) -> DataFrame:
    return df.where("class <> 'abandon'")


def min_height(df: DataFrame, least: float = 10) -> DataFrame:
    return df.withColumn("height", F.col("y2") - F.col("y1")).where(F.col("height") >= least)


def assign_columns(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Column of each box: the one bin it overlaps by ``threshold`` of its own width; 0 for none or several."""
    counts = F.coalesce(F.col("column_counts"), F.lit(1.0))
    n = counts.cast("int")
    step = F.try_divide(F.col("print_x2") + 0.001 - F.col("print_x1"), n)
    edge = lambda k: F.col("print_x1") + k * step

    def meets(k: Column) -> Column:
        shared = F.least(F.col("x2"), edge(k)) - F.greatest(F.col("x1"), edge(k - 1))
        return (shared > 0) & (shared >= (F.col("x2") - F.col("x1")) * threshold)

    bins = F.when(n >= 1, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), meets)).otherwise(F.array().cast("array<int>"))
    one = F.when(F.size("_bins") == 1, F.try_element_at("_bins", F.lit(1))).otherwise(0)
    df = df.withColumn("column_counts", counts).withColumn("_bins", bins).withColumn("column_number", one.cast("int"))
    inside = F.col("column_number") > 0
    return df.withColumns({
        "c1": F.when(inside, edge(F.col("column_number") - 1)).otherwise(F.col("print_x1")).cast("double"),
        "c2": F.when(inside, edge(F.col("column_number"))).otherwise(F.col("print_x2")).cast("double"),
    }).drop("_bins")


def page_blocks(df: DataFrame) -> DataFrame:
    """Block of each box: titles across columns separate blocks; later separators win."""
    is_sep = (F.col("column_number") == 0) & (F.col("class") == "title")
    sep = F.when(is_sep, F.struct("center_y", "box_id", "y1"))
    df = df.withColumn("_seps", F.sort_array(F.collect_list(sep).over(by_page())))

    def number(s: Column, i: Column) -> Column:
        after = F.try_element_at(F.col("_seps"), i + 2)["y1"]
        holds = (s["y1"] <= F.col("y1")) & (after.isNull() | (F.col("y1") < after))
        return F.when((is_sep & (s["box_id"] == F.col("box_id"))) | holds, i + 1).otherwise(0)

    found = F.coalesce(F.array_max(F.transform("_seps", number)), F.lit(0))
    first = F.try_element_at("_seps", F.lit(1))["y1"]
    return df.withColumn("page_block", F.when(first.isNull() | (F.col("y1") < first), 0).otherwise(found).cast("int")).drop("_seps")


def drop_equal_boxes(df: DataFrame) -> DataFrame:
    """Of boxes with equal corners in one block and column, the most confident stays."""
    same = Window.partitionBy("page_id", "page_block", "column_number", "x1", "y1", "x2", "y2")
    nth = F.row_number().over(same.orderBy(F.col("confidence").desc_nulls_last(), "box_id"))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def reading_order(df: DataFrame) -> DataFrame:
    df = drop_equal_boxes(page_blocks(df))
    return df.withColumn("reading_order", F.row_number().over(by_page().orderBy("page_block", "column_number", "y1", "center_y", "box_id")))


def adjust_y2(df: DataFrame) -> DataFrame:
    """Each box of a column ends where the next one starts."""
    along = Window.partitionBy("page_id", "page_block", "column_number").orderBy("y1", "box_id")
    return df.withColumn("y2", F.coalesce(F.lead("y1").over(along), F.col("y2")))


def adjust_x(df: DataFrame) -> DataFrame:
    """Boxes other than figures reach to their column's edges."""
    wide = F.col("class") != "figure"
    return df.withColumns({"x1": F.when(wide, F.least("x1", "c1")).otherwise(F.col("x1")), "x2": F.when(wide, F.greatest("x2", "c2")).otherwise(F.col("x2"))})


def fill_column_gaps(df: DataFrame) -> DataFrame:
    """Add text boxes for empty tops and bottoms of columns, on pages of one block with columns.

    The first and last box of a column each bring their new neighbour along, so
    the page's partitioning holds and nothing is computed twice. Page-wide
    figures of the new boxes cover only the new boxes of the page. They are
    found before the new rows are made, in the order that rows come in from
    ``adjust_y2``, so no rows are sorted here: on a page of one block a column
    is a block's column.
    """
    column = Window.partitionBy("page_id", "page_block", "column_number")
    page = lambda f, *c: f(*c).over(by_page())
    names = df.columns
    df = df.withColumns({"_one": page(F.min, "page_block") == page(F.max, "page_block"), "_cols": page(F.max, "column_number"), "_top": page(F.min, "y1"), "_low": page(F.max, "y2")})
    df = df.withColumns({"_first": F.min("reading_order").over(column), "_last": F.max("reading_order").over(column)})
    ok = F.col("_one") & (F.col("_cols") > 1) & (F.col("column_number") > 0)
    df = df.withColumns({
        "_above": F.coalesce(ok & (F.col("reading_order") == F.col("_first")) & (F.col("y1") > F.col("_top")), F.lit(False)),
        "_below": F.coalesce(ok & (F.col("reading_order") == F.col("_last")) & (F.col("y2") < F.col("_low")), F.lit(False)), "_w": F.col("x2") - F.col("x1"),
    })
    above, below = F.col("_above"), F.col("_below")
    df = df.withColumns({
        "_x1": page(F.min, F.when(above | below, F.col("x1"))), "_y1": page(F.min, F.least(F.when(above, F.col("_top")), F.when(below, F.col("y2")))),
        "_x2": page(F.max, F.when(above | below, F.col("x2"))), "_y2": page(F.max, F.greatest(F.when(above, F.col("y1")), F.when(below, F.col("_low")))),
        "_m": page(F.percentile, "_w", F.lit(0.5), above.cast("int") + below.cast("int")),
    })
    df = df.withColumns({"_pw": (F.col("_x2") - F.col("_x1")).cast("int"), "_ph": (F.col("_y2") - F.col("_y1")).cast("int")})
    df = df.withColumn("_n", F.floor(F.try_divide("_pw", "_m")).cast("double"))
    df = df.select("*", F.explode(F.array_compact(F.array(F.lit(0), F.when(above, 1), F.when(below, 2)))).alias("_k"))
    new, up = F.col("_k") > 0, F.col("_k") == 1
    kept = {"page_id", "filename", "issue", "x1", "x2", "c1", "c2", "column_number", "page_block"}
    own = {
        "class": F.lit("text"), "y1": F.when(up, F.col("_top")).otherwise(F.col("y2")), "y2": F.when(up, F.col("y1")).otherwise(F.col("_low")),
        "reading_order": F.lit(-1), "box_id": F.when(up, -2).otherwise(-1),
    }

    def value(c: str) -> Column:
        if c in kept:
            return F.col(c)
        old = F.when(~new, F.col(c))
        return old.otherwise(own[c]) if c in own else old

    df = df.select(*[value(c).alias(c) for c in names], *[c for c in df.columns if c not in names])
    figures = {
        "width": F.col("_w"), "height": F.col("y2") - F.col("y1"), "ratio": F.try_divide(F.col("y2") - F.col("y1"), F.col("_w")), "center_x": F.col("_w") + F.col("x1"),
        "center_y": F.col("y2"), "median_box_width": F.col("_m"), "print_x1": F.col("_x1"), "print_y1": F.col("_y1"), "print_x2": F.col("_x2"), "print_y2": F.col("_y2"),
        "print_height": F.col("_ph"), "print_width": F.col("_pw"), "print_area": F.col("_ph").cast("long") * F.col("_pw").cast("long"),
        "column_counts": F.col("_n"), "column_width": F.try_divide("_pw", "_n"),
    }
    return df.select(*[(F.when(new, figures[c]).otherwise(F.col(c)) if c in figures else F.col(c)).alias(c) for c in names])


def merge_within_column(df: DataFrame, width_multiplier: float = 1.5) -> DataFrame:
    """Merge neighbours of a column, in reading order, while the result is not too tall and of one class.

    One ordered fold per column over its boxes' corners and classes; figures, tables and column 0 pass through.
    All fields but corners and centres are the first box's.
    """
    order = ["reading_order", "box_id"]
    corners = ["x1", "x2", "y1", "y2"]
    least = lambda p, q: q if p is None else p if q is None else min(p, q)
    greatest = lambda p, q: q if p is None else p if q is None else max(p, q)

    def fold(boxes: list[tuple]) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(boxes)
        held = None  # place, number of boxes, corners, class
        for i, (x1, x2, y1, y2, kind, width, column) in enumerate(boxes):
            alone = kind in ("figure", "table") or column == 0
            if held is not None and not alone:
                at, n, a1, a2, b1, b2, held_kind = held
                top, low = least(b1, y1), greatest(b2, y2)
                if None not in (top, low, width, kind) and kind == held_kind and low - top <= width * width_multiplier:
                    held = (at, n + 1, least(a1, x1), greatest(a2, x2), top, low, kind)
                    continue
            if held is not None:
                out[held[0]], held = held[1:6], None
            if alone:
                out[i] = (1, x1, x2, y1, y2)
            else:
                held = (i, 1, x1, x2, y1, y2, kind)
        if held is not None:
            out[held[0]] = held[1:6]
        return out

    others = [c for c in df.columns if c not in order]
    g = _by_column(df, [*order, *others], [F.col(c).cast("double") for c in corners] + [F.col("class"), F.col("column_width").cast("double"), F.col("column_number").cast("int")], fold, "n int, x1 double, x2 double, y1 double, y2 double")
    middle = lambda c, lo, hi: F.when(F.col("_g.n") > 1, (F.col(f"_g.{lo}") + F.col(f"_g.{hi}")) / 2).otherwise(F.col(c))
    new = {c: F.col(f"_g.{c}").cast(df.schema[c].dataType) for c in corners} | {"center_x": middle("center_x", "x1", "x2"), "center_y": middle("center_y", "y1", "y2")}
    return g.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def _by_column(df: DataFrame, order: list[str], args: list[Column], fold: Callable[[list[tuple]], list[tuple | None]], kind: str) -> DataFrame:
    """The rows of each page's column, in order, for which ``fold`` gives a tuple, and that as ``_g``; rows it gives None are left out.

    Only ``args`` go to Python; rows are neither gathered into arrays nor copied.
    """

    def run(batches: Iterator[tuple]) -> Iterator:
        type_ = pa.struct([pa.field(name, {"int": pa.int32(), "double": pa.float64()}[t]) for name, t in (c.split() for c in kind.split(", "))])
        none = (None,) * type_.num_fields

        def packed(rows: list[tuple | None]) -> pa.StructArray:
            columns = list(zip(*[none if r is None else r for r in rows])) or [()] * type_.num_fields
            # the first field is null where the row is left out
            return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, type_)], fields=list(type_))

        group: list[tuple] = []
        for arrays in batches:
            nth, rows, done, last = arrays[0].to_numpy(), list(zip(*[a.to_pylist() for a in arrays[1:]])), [], 0
            for at in np.flatnonzero(nth == 1):
                group.extend(rows[last:at])
                done.extend(fold(group))
                group, last = [], at
            group.extend(rows[last:])
            if len(group) != nth[-1]:
                raise ValueError("rows of a column came out of order")
            if done:
                yield packed(done)
        if group:
            yield packed(fold(group))

    hints = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    run.__annotations__ = hints
    nth = F.row_number().over(Window.partitionBy("page_id", "column_number").orderBy(*order))
    found = F.arrow_udf(run, kind).asNondeterministic()("_nth", *args)
    return df.withColumn("_nth", nth).withColumn("_g", found).where(F.col("_g").getField(kind.split()[0]).isNotNull()).drop("_nth")


def merge_overlapping(df: DataFrame, least_percent: float = 50.0) -> DataFrame:
    """Greedily merge neighbours in reading order whose heights overlap; page_id, column_number, corners, centres, order.

    The fold compares each box, in reading order, with the group it would join:
    a group takes a box at most one place from its own first place.
    """

    def fold(boxes: list[tuple]) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(boxes)
        taken = [False] * len(boxes)
        for i, (place, x1, y1, x2, y2, cx, cy) in enumerate(boxes):
            if taken[i]:
                continue
            for j in range(i + 1, len(boxes)):
                b = boxes[j]
                if b[0] - place > 1:
                    break
                shared, low = min(y2, b[4]) - max(y1, b[2]), min(y2 - y1, b[4] - b[2])
                if not taken[j] and shared > 0 and low > 0 and 100 * shared / low >= least_percent:
                    taken[j] = True
                    x1, y1, x2, y2 = min(x1, b[1]), min(y1, b[2]), max(x2, b[3]), max(y2, b[4])
                    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
            out[i] = (place, x1, y1, x2, y2, cx, cy)
        return out

    fields = ["x1", "y1", "x2", "y2", "center_x", "center_y"]
    slim = df.select("page_id", F.col("column_number").cast("int").alias("column_number"), F.col("reading_order").cast("int").alias("reading_order"), F.col("box_id").cast("int").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in fields])
    kind = "reading_order int, " + ", ".join(f"{c} double" for c in fields)
    order = ["reading_order", "box_id", *fields]
    return _by_column(slim, order, [F.col(c) for c in ("reading_order", *fields)], fold, kind).select("page_id", "column_number", "_g.*")


def add_issue(df: DataFrame) -> DataFrame:
    return df.withColumn("issue", ids.issue_of(F.col("filename")))


def postprocess(df: DataFrame, least_height: float = 10, width_multiplier: float | None = 1.5, remove_abandon: bool = True, fill_columns: bool = True, partitions: int | None = None) -> DataFrame:
    """The whole chain from detections to ordered boxes with ids.

    Merging goes through Python, after which Spark deals pages out anew: into ``partitions`` by page, if given.
    """
    df = reclassify_abandon(basic_box_data(add_issue(df)))
    if remove_abandon:
        df = drop_abandon(df)
    df = collapse_class(assign_columns(print_area(df)))
    df = adjust_x(adjust_y2(reading_order(df)))
    if fill_columns:
        df = fill_column_gaps(df)
    df = min_height(df, least_height)
    if width_multiplier is not None:
        df = merge_within_column(df, width_multiplier)
        if partitions is not None:
            df = df.repartition(partitions, "page_id")
    df = reading_order(adjust_y2(df))
    df = df.withColumn("box_page_id", ids.box_page_id(F.col("page_block"), F.col("column_number"), F.col("reading_order")))
    return df.withColumn("ratio", F.try_divide("height", "width"))


def fine_tune(df: DataFrame) -> DataFrame:
    """The short chain used for detector training data."""
    return remove_duplicate_boxes(collapse_class(reclassify_abandon(basic_box_data(add_issue(df)))))


def remove_duplicate_boxes(df: DataFrame) -> DataFrame:
    """One box per filename, class and normalised centre and size (six decimals); the image size includes the offset."""
    w, h = F.col("page_width") + F.col("x1"), F.col("page_height") + F.col("y1")
    norms = [F.try_divide((F.col("x1") + F.col("x2")) / 2, w), F.try_divide((F.col("y1") + F.col("y2")) / 2, h), F.try_divide(F.col("x2") - F.col("x1"), w), F.try_divide(F.col("y2") - F.col("y1"), h)]
    same = Window.partitionBy("filename", "class", *[F.bround(x, 6) for x in norms]).orderBy("box_id")
    return df.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def neighbour_overlap(df: DataFrame) -> DataFrame:
    """Vertical overlap of each box with the next one of its column."""
    along = Window.partitionBy("page_id", "column_number").orderBy("reading_order", "box_id")
    nxt = lambda c: F.lead(c).over(along)
    return df.withColumn("overlap_percent", vertical_overlap(F.col("y1"), F.col("y2"), nxt("y1"), nxt("y2"))).where("overlap_percent IS NOT NULL")
