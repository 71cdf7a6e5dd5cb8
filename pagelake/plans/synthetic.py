"""The engine's logical tables derived from the driver's tables, as SQL that both engines read.

``{div}`` is whole-number division. Boxes come from order lines: four to thirty
a page, in four columns, with page-wide titles, exact duplicates, and every
third page without spanning titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]

BOXES = """
WITH ranked AS (
    SELECT l_orderkey {div} 4 AS page, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_discount AS d, l_returnflag AS fl,
        row_number() OVER (PARTITION BY l_orderkey {div} 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS bx
    FROM lineitem
), shaped AS (
    SELECT page, bx, p, fl, d, p % 9 = 0 AS span,
        CASE WHEN p % 9 = 0 THEN p % 20 ELSE (s % 4) * 250 + p % 20 END AS x1,
        CASE WHEN p % 9 = 0 THEN 960 ELSE 200 + s % 30 END AS w,
        ((bx - 1) {div} 4) * 160 + p % 60 AS y1, 20 + 3 * CAST(q AS INT) AS h
    FROM ranked WHERE NOT (page % 3 = 0 AND p % 9 = 0)
), boxes AS (
    SELECT page, bx, p, x1, x1 + w AS x2, y1, y1 + h AS y2, 1 - d AS confidence,
        CASE WHEN span THEN 'title' WHEN p % 11 = 0 THEN 'abandon' WHEN p % 5 = 0 AND fl = 'A' THEN 'figure'
            WHEN p % 7 = 0 AND fl = 'R' THEN 'table' WHEN p % 13 = 0 THEN 'caption' ELSE 'plain text' END AS class
    FROM shaped
)
SELECT CAST(page AS STRING) || '_page_1.png' AS filename, CAST(page AS STRING) || '_page_1' AS page_id, CAST(bx AS INT) AS box_id, class,
    CAST(confidence AS DOUBLE) AS confidence, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2,
    CAST(y2 AS DOUBLE) AS y2, 1200 AS page_width, 2000 AS page_height
FROM boxes
UNION ALL
SELECT CAST(page AS STRING) || '_page_1.png', CAST(page AS STRING) || '_page_1', CAST(1000 + bx AS INT), class,
    CAST(confidence - 0.01 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE), 1200, 2000
FROM boxes WHERE p % 17 = 0
"""

#: Conversations as box texts: a conversation is an issue, a turn is a box, system turns are titles.
BOX_TEXT = """
SELECT CAST(conv_id AS STRING) AS issue_id, CAST(conv_id AS STRING) || '_page_' || CAST(turn {div} 4 AS STRING) AS page_id,
    'B0C1R' || CAST(turn AS STRING) AS box_page_id, CASE WHEN role = 'system' THEN 'title' ELSE 'text' END AS class,
    CAST(turn AS INT) AS reading_order, CASE WHEN turn % 3 = 1 THEN 'THE LEADER.' || chr(10) || 'TO THE EDITOR' || chr(10) || text ELSE text END AS content
FROM conversations
"""


#: Rows of order lines in one partition of boxes: what a task holds doesn't grow with the table.
ROWS_A_TASK = 150_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of boxes, by the number of order lines."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ROWS_A_TASK))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of BOXES, dealt out once by page_id, which all windows of the layout chain share.

    Lines are copied after they are dealt and before they are ranked, since making rows afterwards would lose their order and cost another sort.
    ``line`` keeps equal lines apart, so that each copy stands behind its own line and takes its place.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = F.expr("l_orderkey div 4")
    copies = F.when(F.col("l_partkey") % 17 == 0, F.array(F.lit(0), F.lit(1000))).otherwise(F.array(F.lit(0)))
    lines = lines.select(*ORDER_LINE, F.concat(page.cast("string"), F.lit("_page_1")).alias("page_id")).repartition(tasks(spark, sf_dir), "page_id")
    lines = lines.withColumn("line", F.monotonically_increasing_id()).select("*", F.explode(copies).alias("more"))
    along = Window.partitionBy("page_id").orderBy(*ORDER_LINE, "line", "more").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lines.withColumn("bx", F.count(F.when(F.col("more") == 0, 1)).over(along))
    p, s, q, bx = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "bx"))
    span = p % 9 == 0
    x1, y1 = F.when(span, p % 20).otherwise((s % 4) * 250 + p % 20), F.floor((bx - 1) / 4) * 160 + p % 60
    kind = (
        F.when(span, "title").when(p % 11 == 0, "abandon").when((p % 5 == 0) & (F.col("l_returnflag") == "A"), "figure")
        .when((p % 7 == 0) & (F.col("l_returnflag") == "R"), "table").when(p % 13 == 0, "caption").otherwise("plain text")
    )
    confidence = F.expr("1 - l_discount")
    found = ranked.where(~((page % 3 == 0) & span)).select(
        "page_id", bx.alias("bx"), kind.alias("class"), confidence.cast("double").alias("c0"), F.expr("1 - l_discount - 0.01").cast("double").alias("c1"), x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"), (x1 + F.when(span, 960).otherwise(200 + s % 30)).cast("double").alias("x2"), (y1 + 20 + 3 * q.cast("int")).cast("double").alias("y2"), "more",
    )
    return found.select(
        F.concat("page_id", F.lit(".png")).alias("filename"), "page_id", (F.col("bx") + F.col("more")).cast("int").alias("box_id"), "class", F.when(F.col("more") == 0, F.col("c0")).otherwise(F.col("c1")).alias("confidence"),
        "x1", "y1", "x2", "y2", F.lit(1200).alias("page_width"), F.lit(2000).alias("page_height"),
    )


def box_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(BOX_TEXT.format(div="div").replace("FROM conversations", "FROM {conversations}"), conversations=rows)


def duck(sql: str) -> str:
    return sql.format(div="//").replace("AS STRING)", "AS VARCHAR)")
