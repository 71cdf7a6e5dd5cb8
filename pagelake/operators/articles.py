"""From box texts to articles.

Rows have issue_id, page_id, box_page_id, class, content, reading_order; and
``frame_pos``, their place in the issue's frame, which ``merge_consecutive_titles``
goes by. All windows are per issue, so the chain shuffles once by issue_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import is_title, strip

def by_issue():
    return Window.partitionBy("issue_id")



def with_frame_pos(df: DataFrame) -> DataFrame:
    """Frame order as combined segments come: page, block, column, class, then reading order."""
    keys = [c for c in ("page_number", "block", "column", "class", "reading_order", "box_page_id", "page_id") if c in df.columns]
    return df.withColumn("frame_pos", F.row_number().over(by_issue().orderBy(*keys)))


def split_and_reclassify(df: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """One row per paragraph; its class is title if it reads like one. Null contents stay."""
    if "frame_pos" not in df.columns:
        df = with_frame_pos(df)
    df = df.withColumn("original_class", F.col("class"))
    df = df.select("*", F.posexplode_outer(F.split("content", delimiter)).alias("_pos", "_part")).withColumn("content", strip(F.col("_part")))
    df = df.where(F.col("content").isNull() | (F.col("content") != ""))
    nth = F.row_number().over(Window.partitionBy("issue_id", "frame_pos").orderBy("_pos"))
    title = F.coalesce(is_title(F.col("content")), F.lit(False))
    return df.withColumns({"sub_order": nth, "class": F.when(title, "title").otherwise(F.col("class"))}).drop("_pos", "_part")


def merge_consecutive_titles(df: DataFrame, mode: str = "compat") -> DataFrame:
    """Join titles that follow each other in one box.

    compat: what the operation is known to do. A row that stands before the first
    pair of a run is joined to it, and the run's last title stays apart.
    documented: each run of titles becomes one title.
    Issues without a pair are returned as they are; in others sub_order and then
    reading_order are numbered anew.
    """
    along = by_issue().orderBy("frame_pos", "sub_order")
    nxt = lambda c: F.lead(c).over(along)
    pair = (F.col("class") == "title") & (nxt("class") == "title") & (nxt("page_id") == F.col("page_id")) & (nxt("box_page_id") == F.col("box_page_id")) & (nxt("sub_order") == F.col("sub_order") + 1)
    df = df.withColumn("_pair", F.coalesce(pair, F.lit(False)))
    df = df.withColumns({"_before": F.coalesce(F.lag("_pair").over(along), F.lit(False)), "_after": F.coalesce(F.lead("_pair").over(along), F.lit(False)), "_any": F.max("_pair").over(by_issue())})
    joins_previous = F.col("_pair") if mode == "compat" else F.col("_before")
    kept = ~F.col("_after") if mode == "compat" else ~F.col("_before")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_group": F.sum((~joins_previous).cast("int")).over(upto), "_kept": kept})
    inside = Window.partitionBy("issue_id", "_group").orderBy("frame_pos", "sub_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("content", F.when(F.size(F.collect_list("frame_pos").over(inside)) > 1, F.array_join(F.collect_list("content").over(inside), "\n")).otherwise(F.col("content")))
    df = df.where("_kept")
    box = Window.partitionBy("issue_id", "page_id", "box_page_id").orderBy("frame_pos", "sub_order")
    df = df.withColumn("sub_order", F.when(F.col("_any"), F.row_number().over(box)).otherwise(F.col("sub_order")))
    page = Window.partitionBy("issue_id", "page_id").orderBy("reading_order", "sub_order", "frame_pos")
    df = df.withColumn("reading_order", F.when(F.col("_any"), F.row_number().over(page)).otherwise(F.col("reading_order")))
    return df.drop("_pair", "_before", "_after", "_any", "_group", "_kept")


def create_articles(df: DataFrame) -> DataFrame:
    """One row per article: a title and what follows it up to the next title or the issue's end.

    Pages are ordered by their id as text. An issue's first row counts as the
    title of its article only if another row joins it there.
    """
    order = ["page_id", "reading_order", "sub_order", "frame_pos"]
    along = by_issue().orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_nth", F.row_number().over(along))
    df = df.withColumn("_group", F.sum(((F.col("class") == "title") & (F.col("_nth") > 1)).cast("int")).over(upto))
    rest = [c for c in df.columns if c not in ("_nth", "_group", "issue_id")]
    row = F.struct("_nth", *rest)
    groups = df.groupBy("issue_id", "_group").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.element_at("rows", 1)
    bodies = F.filter("rows", lambda r: r["class"] != "title")
    lone = (first["_nth"] == 1) & (F.size("rows") == 1)
    title = F.when((first["class"] == "title") & ~lone, first["content"])
    lead = F.when(F.size(bodies) > 0, F.try_element_at(bodies, F.lit(1))).otherwise(first)
    parts = F.transform(bodies, lambda r: F.coalesce(r["content"], F.lit("")))
    body = F.array_join(F.concat(F.when(title.isNotNull(), F.array(title)).otherwise(F.array().cast("array<string>")), parts), "\n\n")
    out = groups.select("issue_id", lead.alias("r"), title.alias("title"), body.alias("content"))
    new = {"content": F.col("content"), "class": F.lit("content")}
    out = out.select("issue_id", *[new.get(c, F.col("r")[c]).alias(c) for c in rest], "title")
    page = Window.partitionBy("issue_id", "page_id").orderBy("reading_order", "sub_order", "frame_pos")
    return out.withColumn("reading_order", F.row_number().over(page))


def process_documents(df: DataFrame, delimiter: str = "\n\n", mode: str = "compat") -> DataFrame:
    """Split, merge titles and assemble, issue by issue."""
    return create_articles(merge_consecutive_titles(split_and_reclassify(df, delimiter), mode))
