"""All queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import geometry, ids, text, vectors
from pagelake.operators import articles, compare, coverage, evaluate, jobs, labels, layout, requests, responses, tables
from pagelake.plans import synthetic
from pagelake.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet")


# --- text -----------------------------------------------------------------------------------------------------------
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = STRIP.format(
    r"regexp_replace(replace(replace(replace(regexp_replace(replace({}, '-' || chr(10), 'HYPHENBREAK'), '\n\n+', 'DOUBLEPAGEBREAK', 'g'), chr(10), ' '), 'HYPHENBREAK', ''), 'DOUBLEPAGEBREAK', chr(10) || chr(10)), ' +', ' ', 'g')"
)
LETTERS = "length(regexp_replace({0}, '[^A-Z]', '', 'g')) >= 5 AND length(regexp_replace({0}, '[^AEIOU]', '', 'g')) >= 2 AND {0} = upper({0})"


@query(f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({LETTERS.format('line')}) AS n_titles
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id
""")
def is_title_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_title(F.col("line"))).alias("n_titles"))


@query(r"""
SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS words,
    ((length(text) - length(replace(text, chr(10) || chr(10), ''))) // 2 + 1)::BIGINT AS paragraphs,
    (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))::BIGINT AS filled_lines
FROM documents
""")
def text_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.char_count(t).alias("chars"), text.word_count(t).alias("words"), text.paragraph_count(t).alias("paragraphs"),
        text.line_count(t).alias("lines"), text.filled_count(t, "\n").alias("filled_lines"),
    )


CUSTOM = "'CLD-1850-04-20_page_' || CAST(turn + 1 AS {0}) || '_text_B' || CAST(conv_id % 3 AS {0}) || 'C' || CAST(turn AS {0}) || 'R' || CAST(conv_id AS {0}) || '_segment_' || CAST(turn % 2 AS {0})"


@query("""
SELECT conv_id, turn, 'CLD-1850-04-20' AS issue_id, (turn + 1)::INT AS page_number, 'text' AS class, (conv_id % 3)::INT AS block, turn::INT AS "column",
    conv_id::INT AS reading_order, (turn % 2)::INT AS segment FROM conversations
""")
def parse_custom_id(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("custom_id", F.expr(CUSTOM.format("STRING")))
    return responses.decompose(rows).select("conv_id", "turn", *ids.decompose(F.lit("")))


@query("""
SELECT o_orderkey, 'NSS-' || strftime(o_orderdate, '%Y-%m-%d') || '_page_' || (o_orderkey % 12) AS page_id,
    'NSS-' || strftime(o_orderdate, '%Y-%m-%d') AS issue, 'NSS' AS periodical, o_orderdate::DATE AS issue_date FROM orders
""")
def issue_from_filename(spark, sf_dir):
    name = F.concat(F.lit("NSS-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_page_"), (F.col("o_orderkey") % 12).cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.page_id(name).alias("page_id"), ids.issue_of(name).alias("issue"))
    return rows.select("*", ids.periodical_of(F.col("issue")).alias("periodical"), ids.issue_date(F.col("issue")).alias("issue_date"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN chr(10) || text || ' tsv' ELSE CASE WHEN strpos(text, 'tsv') > 0
    THEN substr(text, 1, strpos(text, 'tsv') - 1) || substr(text, strpos(text, 'tsv') + 3) ELSE text END END AS content
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE trim(text, '`') END AS text FROM conversations)
""")
def fence_strip(spark, sf_dir):
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```tsv\n"), F.col("text"), F.lit(" tsv```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fence_strip(fenced).alias("content"))


@query(f"""
SELECT issue_id, page_id, reading_order, CASE WHEN class = 'title' AND length(content) % 100 > 50 THEN 'text' ELSE class END AS class,
    {CLEAN.format('content')} AS content FROM ({synthetic.duck(synthetic.BOX_TEXT)})
""")
def title_to_text(spark, sf_dir):
    rows = synthetic.box_text(spark, sf_dir).withColumn("completion_tokens", F.length("content") % 100)
    return responses.tidy(rows.withColumn("content", F.concat(F.lit("`"), F.col("content"), F.lit("`")))).select("issue_id", "page_id", "reading_order", "class", "content")


@query("""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '/' || p_type, '[A-Za-z]+|[^A-Za-z]+'),
    lambda x: upper(x[1]) || lower(x[2:])), '') AS titled FROM part
""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit("/"), "p_type")).alias("titled"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')[1:64], ' ') AS head FROM documents")
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 64).alias("head"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, len(words)::DOUBLE AS n, list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))) AS syl,
    greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z]')))) AS sent FROM w)
SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * (n / sent) - 84.6::DOUBLE * (syl / n), 6) AS ease FROM s WHERE n > 0
""")
def reading_ease(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.reading_ease(F.col("text")), 6).alias("ease")).where("ease IS NOT NULL")


# --- layout ---------------------------------------------------------------------------------------------------------
P = "OVER (PARTITION BY page_id)"
AREA = f"""min(x1) {P} AS print_x1, min(y1) {P} AS print_y1, max(x2) {P} AS print_x2, max(y2) {P} AS print_y2,
    trunc(max(y2) {P} - min(y1) {P})::INT AS print_height, trunc(max(x2) {P} - min(x1) {P})::INT AS print_width,
    trunc(max(y2) {P} - min(y1) {P})::BIGINT * trunc(max(x2) {P} - min(x1) {P})::BIGINT AS print_area"""
NO_AREA = "* EXCLUDE (print_x1, print_y1, print_x2, print_y2, print_height, print_width, print_area)"
BASIC = f"""SELECT *, floor(print_width / nullif(median_box_width, 0)) AS column_counts, print_width / nullif(floor(print_width / nullif(median_box_width, 0)), 0) AS column_width FROM (
    SELECT *, x2 - x1 AS width, y2 - y1 AS height, (y2 - y1) / nullif(x2 - x1, 0) AS ratio, x2 AS center_x, y2 AS center_y,
        median(CASE WHEN class = 'text' THEN x2 - x1 END) {P} AS median_box_width, {AREA} FROM {{}})"""
ORDER = """SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY page_id ORDER BY page_block, column_number, y1, center_y, box_id)::INT AS reading_order FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, page_block, column_number, x1, y1, x2, y2 ORDER BY confidence DESC NULLS LAST, box_id) AS nth FROM {}) WHERE nth = 1"""
BLOCK = """SELECT b.*, CASE WHEN f.y IS NULL OR b.y1 < f.y THEN 0 ELSE coalesce(m.i, 0) END::INT AS page_block FROM {0} b
    LEFT JOIN (SELECT page_id, y1 AS y FROM {1} WHERE i = 1) f ON f.page_id = b.page_id
    LEFT JOIN (SELECT b.page_id, b.box_id, max(s.i) AS i FROM {0} b JOIN {1} s ON s.page_id = b.page_id AND (s.box_id = b.box_id OR (s.y1 <= b.y1 AND (s.nxt IS NULL OR b.y1 < s.nxt)))
        GROUP BY b.page_id, b.box_id) m ON m.page_id = b.page_id AND m.box_id = b.box_id"""
SEPS = "SELECT page_id, box_id, y1, row_number() OVER w AS i, lead(y1) OVER w AS nxt FROM {} WHERE column_number = 0 AND class = 'title' WINDOW w AS (PARTITION BY page_id ORDER BY center_y, box_id)"
Y2 = "SELECT * REPLACE (coalesce(lead(y1) OVER (PARTITION BY page_id, page_block, column_number ORDER BY y1, box_id), y2) AS y2) FROM {}"
STEPS = [
    ("raw", synthetic.duck(synthetic.BOXES)),
    ("named", "SELECT * REPLACE (CASE WHEN class = 'plain text' THEN 'text' ELSE class END AS class), regexp_replace(filename, '_page_.*', '') AS issue FROM raw"),
    ("basic", BASIC.format("named")),
    ("lined", f"SELECT *, max(CASE WHEN class = 'abandon' AND y1 <= print_y1 + 0.1::DOUBLE * print_height THEN y2 END) {P} AS abandon_line FROM basic"),
    ("marked", "SELECT * REPLACE (CASE WHEN center_y <= abandon_line THEN 'abandon' ELSE class END AS class) FROM lined"),
    ("kept", f"SELECT {NO_AREA}, {AREA} FROM marked WHERE class <> 'abandon'"),
    ("binned", """SELECT * REPLACE (coalesce(column_counts, 1.0) AS column_counts), (print_x2 + 0.001::DOUBLE - print_x1) / nullif(coalesce(column_counts, 1)::INT, 0) AS step,
        list_filter(range(1, coalesce(column_counts, 1)::INT + 1), lambda k: least(x2, print_x1 + k * ((print_x2 + 0.001::DOUBLE - print_x1) / nullif(coalesce(column_counts, 1)::INT, 0)))
            - greatest(x1, print_x1 + (k - 1) * ((print_x2 + 0.001::DOUBLE - print_x1) / nullif(coalesce(column_counts, 1)::INT, 0))) > 0
            AND least(x2, print_x1 + k * ((print_x2 + 0.001::DOUBLE - print_x1) / nullif(coalesce(column_counts, 1)::INT, 0)))
            - greatest(x1, print_x1 + (k - 1) * ((print_x2 + 0.001::DOUBLE - print_x1) / nullif(coalesce(column_counts, 1)::INT, 0))) >= (x2 - x1) * 0.1::DOUBLE) AS bins FROM kept"""),
    ("placed", """SELECT * EXCLUDE (bins, step), CASE WHEN len(bins) = 1 THEN bins[1] ELSE 0 END::INT AS column_number,
        CASE WHEN len(bins) = 1 THEN print_x1 + (bins[1] - 1) * step ELSE print_x1 END AS c1, CASE WHEN len(bins) = 1 THEN print_x1 + bins[1] * step ELSE print_x2 END AS c2 FROM binned"""),
    ("collapsed", "SELECT * REPLACE (CASE WHEN class IN ('figure', 'table', 'text', 'abandon') THEN class ELSE 'title' END AS class) FROM placed"),
    ("seps", SEPS.format("collapsed")),
    ("blocked", BLOCK.format("collapsed", "seps")),
    ("ordered", ORDER.format("blocked")),
    ("trimmed", Y2.format("ordered")),
    ("widened", "SELECT * REPLACE (CASE WHEN class <> 'figure' THEN least(x1, c1) ELSE x1 END AS x1, CASE WHEN class <> 'figure' THEN greatest(x2, c2) ELSE x2 END AS x2) FROM trimmed"),
    ("pages", "SELECT page_id, min(y1) AS top, max(y2) AS low FROM widened GROUP BY page_id HAVING count(DISTINCT page_block) = 1 AND max(column_number) > 1"),
    ("cols", """SELECT w.page_id, column_number, any_value(filename) AS filename, any_value(issue) AS issue, min(c1) AS c1, min(c2) AS c2, arg_min({'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'b': page_block}, reading_order) AS a,
        arg_max({'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'b': page_block}, reading_order) AS b, any_value(top) AS top, any_value(low) AS low
        FROM widened w JOIN pages p ON w.page_id = p.page_id WHERE column_number > 0 GROUP BY w.page_id, column_number"""),
    ("fresh", BASIC.format("""(SELECT page_id, filename, issue, column_number, c1, c2, a.x1 AS x1, a.x2 AS x2, top AS y1, a.y1 AS y2, a.b AS page_block, -2 AS box_id, 'text' AS class, -1 AS reading_order FROM cols WHERE a.y1 > top
        UNION ALL SELECT page_id, filename, issue, column_number, c1, c2, b.x1, b.x2, b.y2, low, b.b, -1, 'text', -1 FROM cols WHERE b.y2 < low)""")),
    ("filled", "SELECT * FROM widened UNION ALL BY NAME SELECT * FROM fresh"),
    ("tall", "SELECT * REPLACE (y2 - y1 AS height) FROM filled WHERE y2 - y1 >= 10"),
    ("queue", "SELECT *, row_number() OVER (PARTITION BY page_id, column_number ORDER BY reading_order, box_id) AS rn FROM tall"),
    ("folded", """SELECT page_id, column_number, rn, class, 1 AS grp, x1 AS hx1, x2 AS hx2, y1 AS hy1, y2 AS hy2, false AS joined FROM queue WHERE rn = 1
        UNION ALL SELECT q.page_id, q.column_number, q.rn, q.class, CASE WHEN q.ok THEN q.grp ELSE q.grp + 1 END, CASE WHEN q.ok THEN least(q.hx1, q.x1) ELSE q.x1 END, CASE WHEN q.ok THEN greatest(q.hx2, q.x2) ELSE q.x2 END,
            CASE WHEN q.ok THEN least(q.hy1, q.y1) ELSE q.y1 END, CASE WHEN q.ok THEN greatest(q.hy2, q.y2) ELSE q.y2 END, q.ok
        FROM (SELECT o.*, f.grp, f.hx1, f.hx2, f.hy1, f.hy2, coalesce(o.column_number <> 0 AND o.class NOT IN ('figure', 'table') AND o.class = f.class
            AND greatest(o.y2, f.hy2) - least(o.y1, f.hy1) <= o.column_width * 1.5::DOUBLE, false) AS ok
            FROM folded f JOIN queue o ON o.page_id = f.page_id AND o.column_number = f.column_number AND o.rn = f.rn + 1) q"""),
    ("merged", """SELECT q.* EXCLUDE (rn) REPLACE (g.x1 AS x1, g.x2 AS x2, g.y1 AS y1, g.y2 AS y2, CASE WHEN g.n > 1 THEN (g.x1 + g.x2) / 2 ELSE q.center_x END AS center_x, CASE WHEN g.n > 1 THEN (g.y1 + g.y2) / 2 ELSE q.center_y END AS center_y)
        FROM queue q JOIN (SELECT page_id, column_number, grp, min(rn) AS rn, count(*) AS n, min(hx1) AS x1, max(hx2) AS x2, min(hy1) AS y1, max(hy2) AS y2 FROM folded GROUP BY page_id, column_number, grp) g
        ON g.page_id = q.page_id AND g.column_number = q.column_number AND g.rn = q.rn"""),
    ("trimmed2", Y2.format("merged")),
    ("again", "SELECT * EXCLUDE (page_block, reading_order) FROM trimmed2"),
    ("seps2", SEPS.format("again")),
    ("blocked2", BLOCK.format("again", "seps2")),
    ("done", ORDER.format("blocked2")),
]


def upto(name: str, select: str) -> str:
    """SQL of the layout chain up to one step."""
    n = [k for k, _ in STEPS].index(name) + 1
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in STEPS[:n])
    return f"WITH RECURSIVE {ctes}\nSELECT {select} FROM {name}"


def _named(spark, sf_dir):
    return layout.add_issue(layout.normalise_class(synthetic.boxes(spark, sf_dir)))


def _marked(spark, sf_dir):
    return layout.reclassify_abandon(layout.basic_box_data(_named(spark, sf_dir)))


def _placed(spark, sf_dir):
    return layout.assign_columns(layout.print_area(layout.drop_abandon(_marked(spark, sf_dir))))


def _ordered(spark, sf_dir):
    return layout.reading_order(layout.collapse_class(_placed(spark, sf_dir)))


def _widened(spark, sf_dir):
    return layout.adjust_x(layout.adjust_y2(_ordered(spark, sf_dir)))


BOX = ["page_id", "box_id"]
LAYOUT = {
    "box_basic": ("basic", ["class", "width", "height", "ratio", "center_x", "center_y", "median_box_width", "column_counts", "column_width"], lambda s, d: layout.basic_box_data(_named(s, d))),
    "print_area": ("kept", ["print_x1", "print_y1", "print_x2", "print_y2", "print_height", "print_width", "print_area"], lambda s, d: layout.print_area(layout.drop_abandon(_marked(s, d)))),
    "abandon_reclass": ("marked", ["class", "abandon_line"], _marked),
    "assign_columns": ("placed", ["column_number", "c1", "c2"], _placed),
    "class_collapse": ("collapsed", ["class"], lambda s, d: layout.collapse_class(_placed(s, d))),
    "page_blocks": ("blocked", ["page_block"], lambda s, d: layout.page_blocks(layout.collapse_class(_placed(s, d)))),
    "reading_order": ("ordered", ["page_block", "column_number", "reading_order"], _ordered),
    "adjust_y2": ("trimmed", ["y1", "y2"], lambda s, d: layout.adjust_y2(_ordered(s, d))),
    "adjust_x": ("widened", ["x1", "x2"], _widened),
    "fill_gaps": ("filled", ["column_number", "class", "x1", "x2", "y1", "y2", "reading_order", "print_height", "column_width"], lambda s, d: layout.fill_column_gaps(_widened(s, d))),
    "min_height": ("tall", ["height", "column_number", "y1"], lambda s, d: layout.min_height(layout.fill_column_gaps(_widened(s, d)))),
    "merge_boxes": ("merged", ["column_number", "class", "x1", "x2", "y1", "y2", "center_x", "center_y", "reading_order"], lambda s, d: layout.merge_within_column(layout.min_height(layout.fill_column_gaps(_widened(s, d))))),
}
for _name, (_step, _cols, _make) in LAYOUT.items():
    QUERIES[_name] = lambda s, d, make=_make, cols=_cols: make(s, d).select(*BOX, *cols)
    ORACLES[_name] = upto(_step, ", ".join(BOX + _cols))


@query(upto("ordered", "page_id, box_id, confidence"))
def dedupe_boxes(spark, sf_dir):
    return layout.drop_equal_boxes(layout.page_blocks(layout.collapse_class(_placed(spark, sf_dir)))).select(*BOX, "confidence")


@query(upto("done", "page_id, box_id, class, x1, x2, y1, y2, reading_order, 'B' || page_block || 'C' || column_number || 'R' || reading_order AS box_page_id, height / nullif(width, 0) AS ratio"))
def postprocess_bbox(spark, sf_dir):
    done = layout.postprocess(layout.normalise_class(synthetic.boxes(spark, sf_dir)), partitions=synthetic.tasks(spark, sf_dir))
    return done.select(*BOX, "class", "x1", "x2", "y1", "y2", "reading_order", "box_page_id", "ratio")


@query(f"""
WITH b AS ({synthetic.duck(synthetic.BOXES)})
SELECT page_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY filename, class, round_even(((x1 + x2) / 2) / (page_width + x1), 6), round_even(((y1 + y2) / 2) / (page_height + y1), 6),
    round_even((x2 - x1) / (page_width + x1), 6), round_even((y2 - y1) / (page_height + y1), 6) ORDER BY box_id) AS n FROM b) WHERE n = 1
""")
def remove_duplicate_boxes(spark, sf_dir):
    return layout.remove_duplicate_boxes(synthetic.boxes(spark, sf_dir)).select(*BOX)


@query(upto("collapsed", "count(*) AS n").replace("SELECT count(*) AS n FROM collapsed", """SELECT page_id, box_id, class FROM (SELECT *, row_number() OVER (PARTITION BY filename, class, round_even(((x1 + x2) / 2) / (page_width + x1), 6),
    round_even(((y1 + y2) / 2) / (page_height + y1), 6), round_even((x2 - x1) / (page_width + x1), 6), round_even((y2 - y1) / (page_height + y1), 6) ORDER BY box_id) AS n
    FROM (SELECT * REPLACE (CASE WHEN class IN ('figure', 'table', 'text', 'abandon') THEN class ELSE 'title' END AS class) FROM marked)) WHERE n = 1"""))
def fine_tune_boxes(spark, sf_dir):
    return layout.fine_tune(layout.normalise_class(synthetic.boxes(spark, sf_dir))).select(*BOX, "class")


OVERLAP = """SELECT page_id, box_id, CASE WHEN least(y2, n2) - greatest(y1, n1) <= 0 THEN 0.0 ELSE (least(y2, n2) - greatest(y1, n1)) / nullif(least(y2 - y1, n2 - n1), 0) * 100 END::DOUBLE AS overlap_percent FROM (
    SELECT *, lead(y1) OVER w AS n1, lead(y2) OVER w AS n2 FROM ordered WINDOW w AS (PARTITION BY page_id, column_number ORDER BY reading_order, box_id)) WHERE n1 IS NOT NULL AND NOT (least(y2, n2) - greatest(y1, n1) > 0 AND least(y2 - y1, n2 - n1) = 0)"""


@query(upto("ordered", "1").replace("SELECT 1 FROM ordered", OVERLAP))
def vertical_overlap(spark, sf_dir):
    from pyspark.sql import Window

    along = Window.partitionBy("page_id", "column_number").orderBy("reading_order", "box_id")
    rows = _ordered(spark, sf_dir).withColumns({"n1": F.lead("y1").over(along), "n2": F.lead("y2").over(along)}).where("n1 IS NOT NULL")
    found = rows.select(*BOX, geometry.vertical_overlap(F.col("y1"), F.col("y2"), F.col("n1"), F.col("n2")).alias("overlap_percent"))
    return found.where("overlap_percent IS NOT NULL")


@query(upto("ordered", "1").replace("SELECT 1 FROM ordered", "").rstrip() + """,
turns AS (SELECT page_id, column_number, reading_order, x1, y1, x2, y2, center_x, center_y, row_number() OVER (PARTITION BY page_id, column_number ORDER BY reading_order, box_id) AS rn FROM ordered),
met AS (SELECT *, coalesce(reading_order - lag(reading_order) OVER w <= 1 AND least(lag(y2) OVER w, y2) - greatest(lag(y1) OVER w, y1) > 0 AND least(lag(y2) OVER w - lag(y1) OVER w, y2 - y1) > 0
    AND 100 * (least(lag(y2) OVER w, y2) - greatest(lag(y1) OVER w, y1)) / least(lag(y2) OVER w - lag(y1) OVER w, y2 - y1) >= 50, false) AS meets FROM turns WINDOW w AS (PARTITION BY page_id, column_number ORDER BY rn)),
taken AS (SELECT page_id, column_number, rn, false AS taken FROM met WHERE rn = 1
    UNION ALL SELECT m.page_id, m.column_number, m.rn, m.meets AND NOT t.taken FROM taken t JOIN met m ON m.page_id = t.page_id AND m.column_number = t.column_number AND m.rn = t.rn + 1),
pairs AS (SELECT m.*, t.taken, coalesce(lead(t.taken) OVER w, false) AS takes, lead(m.x1) OVER w AS a1, lead(m.y1) OVER w AS b1, lead(m.x2) OVER w AS a2, lead(m.y2) OVER w AS b2
    FROM met m JOIN taken t USING (page_id, column_number, rn) WINDOW w AS (PARTITION BY page_id, column_number ORDER BY rn))
SELECT page_id, column_number, reading_order, CASE WHEN takes THEN least(x1, a1) ELSE x1 END AS x1, CASE WHEN takes THEN least(y1, b1) ELSE y1 END AS y1, CASE WHEN takes THEN greatest(x2, a2) ELSE x2 END AS x2,
    CASE WHEN takes THEN greatest(y2, b2) ELSE y2 END AS y2, CASE WHEN takes THEN (least(x1, a1) + greatest(x2, a2)) / 2 ELSE center_x END AS center_x, CASE WHEN takes THEN (least(y1, b1) + greatest(y2, b2)) / 2 ELSE center_y END AS center_y
FROM pairs WHERE NOT taken""")
def merge_overlapping_boxes(spark, sf_dir):
    return layout.merge_overlapping(_ordered(spark, sf_dir))


COVER = """
clipped AS (SELECT page_id, class = 'figure' AS fig, least(greatest(trunc(x1 - print_x1)::INT, 0), print_width) AS a, least(greatest(trunc(x2 - print_x1)::INT, 0), print_width) AS b,
    least(greatest(trunc(y1 - print_y1)::INT, 0), print_height) AS c, least(greatest(trunc(y2 - print_y1)::INT, 0), print_height) AS d FROM {0}),
xs AS (SELECT page_id, x, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS nx FROM (SELECT page_id, a AS x FROM clipped UNION SELECT page_id, b FROM clipped)),
ys AS (SELECT page_id, y, lead(y) OVER (PARTITION BY page_id ORDER BY y) AS ny FROM (SELECT page_id, c AS y FROM clipped UNION SELECT page_id, d FROM clipped)),
cells AS (SELECT xs.page_id, x, y, (nx - x)::BIGINT * (ny - y) AS area, count(*) FILTER (NOT fig) AS t, count(*) FILTER (fig) AS f FROM xs JOIN ys ON xs.page_id = ys.page_id
    JOIN clipped k ON k.page_id = xs.page_id AND k.a <= x AND nx <= k.b AND k.c <= y AND ny <= k.d GROUP BY ALL),
sums AS (SELECT page_id, sum(area) FILTER (t > 0) AS tc, sum(area) FILTER (t > 1) AS tt, sum(area) FILTER (t > 0 AND f > 0) AS ti, sum(area) FILTER (t + f > 0) AS c, sum(area) FILTER (t + f > 1) AS o FROM cells GROUP BY page_id),
cover AS (SELECT p.*, coalesce(tc, 0)::BIGINT AS text_coverage_pixels, coalesce(tt, 0)::BIGINT AS text_overlap_pixels, coalesce(ti, 0)::BIGINT AS text_image_overlap,
    coalesce(c, 0)::BIGINT AS total_covered_pixels, coalesce(o, 0)::BIGINT AS total_overlap,
    round_even(coalesce(o, 0)::DOUBLE / nullif(maximum_print_area, 0), 2) AS perc_print_area_overlap, round_even(coalesce(c, 0)::DOUBLE / nullif(maximum_print_area, 0), 2) AS perc_print_area_coverage
    FROM (SELECT page_id, max(print_height) AS print_height, max(print_width) AS print_width, min(print_x1) AS x_min, min(print_y1) AS y_min, max(print_area) AS maximum_print_area FROM {0} GROUP BY page_id) p LEFT JOIN sums USING (page_id))
"""


@query(upto("collapsed", "1").replace("SELECT 1 FROM collapsed", "") .rstrip() + ", " + COVER.format("collapsed") + "SELECT * FROM cover")
def coverage_overlap(spark, sf_dir):
    return coverage.page_coverage(layout.collapse_class(_placed(spark, sf_dir)))


def _cover_suffixed(source: str, tag: str) -> str:
    names = ("clipped", "xs", "ys", "cells", "sums", "cover")
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m[1] + tag, COVER.format(source))


@query(
    upto("widened", "1").replace("SELECT 1 FROM widened", "").rstrip() + ", " + _cover_suffixed("collapsed", "_a") + ", " + _cover_suffixed("widened", "_b")
    + """SELECT a.page_id, b.perc_print_area_overlap - a.perc_print_area_overlap AS overlap_diff, b.perc_print_area_coverage - a.perc_print_area_coverage AS coverage_diff
    FROM cover_a a JOIN cover_b b ON a.page_id = b.page_id"""
)
def coverage_delta(spark, sf_dir):
    raw = coverage.page_coverage(layout.collapse_class(_placed(spark, sf_dir)))
    return coverage.coverage_delta(raw, coverage.page_coverage(_widened(spark, sf_dir)))


@query(f"""
WITH b AS ({synthetic.duck(synthetic.BOXES)}), c AS (SELECT page_id, box_id, greatest(0, trunc(x1 - 30)::INT) AS x1, greatest(0, trunc(y1 - 30)::INT) AS y1, least(900, trunc(x2)::INT) AS x2, least(700, trunc(y2)::INT) AS y2 FROM b)
SELECT *, x2 > x1 AND y2 > y1 AS valid FROM c
""")
def crop_clamp(spark, sf_dir):
    box = geometry.clamp(F.col("x1") - 30, F.col("y1") - 30, F.col("x2"), F.col("y2"), F.lit(900), F.lit(700))
    return synthetic.boxes(spark, sf_dir).select(*BOX, box.alias("c")).select(*BOX, "c.*")


@query(f"""
WITH RECURSIVE b AS (SELECT page_id, box_id, (10 + box_id % 40)::INT AS w, trunc(y2 - y1)::INT * 2 AS h FROM ({synthetic.duck(synthetic.BOXES)})),
s AS (SELECT *, floor(w * 1.5::DOUBLE)::INT AS size, floor(w * 1.5::DOUBLE)::INT - floor(floor(w * 1.5::DOUBLE) * 0.2::DOUBLE)::INT AS step FROM b),
r AS (SELECT *, 0 AS k FROM s UNION ALL SELECT page_id, box_id, w, h, size, step, k + 1 FROM r WHERE h::DOUBLE / w > 1.5::DOUBLE AND k * step + size < h AND k < 19)
SELECT page_id, box_id, k, CASE WHEN h::DOUBLE / w <= 1.5::DOUBLE THEN 0 WHEN k * step + size > h THEN greatest(0, h - size) ELSE k * step END::INT AS y0,
    CASE WHEN h::DOUBLE / w <= 1.5::DOUBLE THEN h ELSE least(k * step + size, h) END::INT AS y1 FROM r
""")
def split_plan(spark, sf_dir):
    rows = synthetic.boxes(spark, sf_dir).select(*BOX, (10 + F.col("box_id") % 40).alias("w"), ((F.col("y2") - F.col("y1")).cast("int") * 2).alias("h"))
    return geometry.split_rows(rows, F.col("w"), F.col("h")).select(*BOX, "k", "y0", "y1")


@query(upto("done", "1").replace("SELECT 1 FROM done", "").rstrip() + """,
crops AS (SELECT page_id, class, 'B' || page_block || 'C' || column_number || 'R' || reading_order AS box_page_id, greatest(0, trunc(x1)::INT) AS a, greatest(0, trunc(y1)::INT) AS b, least(1200, trunc(x2)::INT) AS c, least(2000, trunc(y2)::INT) AS d FROM done),
sized AS (SELECT *, c - a AS w, d - b AS h, floor((c - a) * 1.5::DOUBLE)::INT AS size, floor((c - a) * 1.5::DOUBLE)::INT - floor(floor((c - a) * 1.5::DOUBLE) * 0.2::DOUBLE)::INT AS step FROM crops WHERE c > a AND d > b),
parts AS (SELECT *, class = 'figure' OR h::DOUBLE / w <= 1.5::DOUBLE OR step <= 0 AS whole FROM sized),
cut AS (SELECT *, unnest(range(CASE WHEN whole THEN 1 ELSE least(20, greatest(1, ceil((h - size) / step::DOUBLE)::INT + 1)) END))::INT AS k FROM parts)
SELECT page_id, class, box_page_id, k AS segment, a AS crop_x1, c AS crop_x2, b + CASE WHEN whole THEN 0 WHEN k * step + size > h THEN greatest(0, h - size) ELSE k * step END AS crop_y1,
    b + CASE WHEN whole THEN h ELSE least(k * step + size, h) END AS crop_y2, CASE WHEN class <> 'figure' AND h < w THEN floor((w - h) / 2::DOUBLE) ELSE 0 END::INT AS pad_top,
    page_id || '_' || class || '_' || box_page_id || '_segment_' || k AS custom_id FROM cut""")
def request_plan(spark, sf_dir):
    return requests.request_plan(layout.postprocess(layout.normalise_class(synthetic.boxes(spark, sf_dir)), partitions=synthetic.tasks(spark, sf_dir)).withColumns({"page_width": F.lit(1200), "page_height": F.lit(2000)}))


# --- responses and articles -----------------------------------------------------------------------------------------
@query("""
SELECT conv_id::VARCHAR || '-' || turn AS custom_id, length(text)::INT AS prompt_tokens, turn::INT AS completion_tokens, (length(text) + turn)::INT AS total_tokens,
    CASE WHEN turn % 5 <> 0 THEN 'stop' END AS finish_reason, CASE WHEN turn % 5 <> 0 THEN text END AS content FROM conversations WHERE turn % 7 <> 6
""")
def responses_flatten(spark, sf_dir):
    choice = F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.col("text").alias("content")).alias("message"))
    usage = F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (F.length("text") + F.col("turn")).alias("total_tokens"))
    body = F.struct(usage.alias("usage"), F.when(F.col("turn") % 5 != 0, F.array(choice)).otherwise(F.array().cast("array<struct<finish_reason:string,message:struct<content:string>>>")).alias("choices"))
    line = F.to_json(F.struct(F.lit("x").alias("id"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    lines = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 7 == 6, "not json").otherwise(line).alias("value"))
    return responses.flatten(responses.decode(lines)).drop("id")


@query()
def segments_knit(spark, sf_dir):
    return _segments_knit(table(spark, sf_dir, "documents"))


def _segments_knit(docs: DataFrame) -> DataFrame:
    """Whole texts cut into segments of 300 characters that overlap by 50, and knitted again."""
    part = F.struct(F.col("k").alias("segment"), F.substring("text", F.lit(1) + F.col("k") * 250, F.lit(300)).alias("content"))
    segments = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.coalesce(F.length("text"), F.lit(0)) - 300) / 250).cast("int")))).alias("k"))
    segments = segments.select(F.concat(F.lit("CLD-1850-04-20_page_1_text_B0C1R"), F.col("doc_id").cast("string"), F.lit("_segment_"), F.col("k").cast("string")).alias("custom_id"), part["content"].alias("content"),
                               F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(3).alias("total_tokens"))
    return responses.combine_segments(responses.decompose(segments))


@query("""
SELECT to_json({custom_id: conv_id::VARCHAR || '-' || turn, body: {max_tokens: 2000, messages: [{role: 'user', content: 'Summarise: ' || text}]}})::VARCHAR AS value FROM conversations
""")
def request_jsonl(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"), F.concat(F.lit("Summarise: "), F.col("text")).alias("prompt"))
    return requests.text_lines(rows)


TITLE = LETTERS.format("content")
SPLIT = f"""
framed AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY class, reading_order, box_page_id, page_id)::INT AS frame_pos FROM ({synthetic.duck(synthetic.BOX_TEXT)})),
parts AS (SELECT * EXCLUDE (content), class AS original_class, unnest(string_split(content, chr(10))) AS part, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM framed),
stripped AS (SELECT * EXCLUDE (part), {STRIP.format('part')} AS content FROM parts),
paras AS (SELECT * EXCLUDE (pos) REPLACE (CASE WHEN {TITLE} THEN 'title' ELSE class END AS class), row_number() OVER (PARTITION BY issue_id, frame_pos ORDER BY pos)::INT AS sub_order FROM stripped WHERE content <> '')
"""


def _merge_sql(compat: bool) -> str:
    joins, keep = ("pair", "NOT nxt") if compat else ("prev", "NOT prev")
    return f""",
pairs AS (SELECT *, coalesce(class = 'title' AND lead(class) OVER w = 'title' AND lead(page_id) OVER w = page_id AND lead(box_page_id) OVER w = box_page_id AND lead(sub_order) OVER w = sub_order + 1, false) AS pair
    FROM paras WINDOW w AS (PARTITION BY issue_id ORDER BY frame_pos, sub_order)),
near AS (SELECT *, coalesce(lag(pair) OVER w, false) AS prev, coalesce(lead(pair) OVER w, false) AS nxt, bool_or(pair) OVER (PARTITION BY issue_id) AS has_pair FROM pairs WINDOW w AS (PARTITION BY issue_id ORDER BY frame_pos, sub_order)),
runs AS (SELECT *, sum(CASE WHEN {joins} THEN 0 ELSE 1 END) OVER (PARTITION BY issue_id ORDER BY frame_pos, sub_order) AS run FROM near),
texts AS (SELECT issue_id, run, string_agg(content, chr(10) ORDER BY frame_pos, sub_order) AS joined FROM runs GROUP BY ALL),
one AS (SELECT r.* REPLACE (joined AS content) FROM runs r JOIN texts t ON r.issue_id = t.issue_id AND r.run = t.run WHERE {keep}),
subbed AS (SELECT * REPLACE (CASE WHEN has_pair THEN row_number() OVER (PARTITION BY issue_id, page_id, box_page_id ORDER BY frame_pos, sub_order) ELSE sub_order END::INT AS sub_order) FROM one),
glued AS (SELECT * REPLACE (CASE WHEN has_pair THEN row_number() OVER (PARTITION BY issue_id, page_id ORDER BY reading_order, sub_order, frame_pos) ELSE reading_order END::INT AS reading_order) FROM subbed)"""


ARTICLES = """,
nths AS (SELECT *, row_number() OVER w AS nth FROM glued WINDOW w AS (PARTITION BY issue_id ORDER BY page_id, reading_order, sub_order, frame_pos)),
groups AS (SELECT *, sum(CASE WHEN class = 'title' AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY issue_id ORDER BY nth) AS g FROM nths),
heads AS (SELECT issue_id, g, count(*) AS n, arg_min(nth, nth) AS first_nth, arg_min(class, nth) AS first_class, arg_min(content, nth) AS first_content, min(nth) FILTER (class <> 'title') AS body_nth,
    string_agg(content, chr(10) || chr(10) ORDER BY nth) FILTER (class <> 'title') AS body FROM groups GROUP BY ALL),
titled AS (SELECT *, CASE WHEN first_class = 'title' AND NOT (first_nth = 1 AND n = 1) THEN first_content END AS title FROM heads),
arts AS (SELECT q.* EXCLUDE (content, class, nth, g), t.title, concat_ws(chr(10) || chr(10), t.title, t.body) AS content FROM titled t JOIN groups q ON q.issue_id = t.issue_id AND q.nth = coalesce(t.body_nth, t.first_nth)),
numbered AS (SELECT * REPLACE (row_number() OVER (PARTITION BY issue_id, page_id ORDER BY reading_order, sub_order, frame_pos)::INT AS reading_order) FROM arts)"""
PARA = ["issue_id", "page_id", "box_page_id", "class", "original_class", "reading_order", "sub_order", "content"]
ART = ["issue_id", "page_id", "box_page_id", "original_class", "reading_order", "sub_order", "title", "content"]


@query(f"WITH {SPLIT} SELECT {', '.join(PARA)} FROM paras")
def split_reclassify(spark, sf_dir):
    return articles.split_and_reclassify(synthetic.box_text(spark, sf_dir), "\n").select(*PARA)


@query(f"WITH {SPLIT}{_merge_sql(True)} SELECT {', '.join(PARA)} FROM glued")
def merge_titles_compat(spark, sf_dir):
    return articles.merge_consecutive_titles(articles.split_and_reclassify(synthetic.box_text(spark, sf_dir), "\n")).select(*PARA)


@query(f"WITH {SPLIT}{_merge_sql(False)} SELECT {', '.join(PARA)} FROM glued")
def merge_titles_documented(spark, sf_dir):
    return articles.merge_consecutive_titles(articles.split_and_reclassify(synthetic.box_text(spark, sf_dir), "\n"), "documented").select(*PARA)


@query(f"WITH {SPLIT}, glued AS (SELECT * FROM paras){ARTICLES} SELECT {', '.join(ART)} FROM numbered")
def create_articles(spark, sf_dir):
    return articles.create_articles(articles.split_and_reclassify(synthetic.box_text(spark, sf_dir), "\n")).select(*ART)


@query(f"WITH {SPLIT}{_merge_sql(True)}{ARTICLES} SELECT {', '.join(ART)} FROM numbered")
def process_documents(spark, sf_dir):
    return articles.process_documents(synthetic.box_text(spark, sf_dir), "\n").select(*ART)


@query(f"WITH {SPLIT}{_merge_sql(True)}{ARTICLES} SELECT issue_id, count(*) AS n_articles, sum(length(content))::BIGINT AS n_chars, count(title) AS n_titles FROM numbered GROUP BY issue_id")
def article_counts(spark, sf_dir):
    rows = articles.process_documents(synthetic.box_text(spark, sf_dir), "\n")
    return rows.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n_articles"), F.sum(F.length("content")).alias("n_chars"), F.count("title").alias("n_titles"))


# --- evaluation -----------------------------------------------------------------------------------------------------
OCR = """SELECT item_id, item_id % 2 AS dataset, model, CASE model WHEN 'a' THEN text WHEN 'b' THEN translate(text, 'eo', 'co') WHEN 'c' THEN translate(text, 'aeiou', 'xeoiu') ELSE text || text END AS content, text AS truth
    FROM benchmark, (VALUES ('a'), ('b'), ('c'), ('d')) m(model)"""
#: DuckDB's levenshtein counts bytes; capitals, which lower-cased texts don't have, stand in for letters of two bytes.
ONE_BYTE = "translate(lower({}), 'äçèéêíñóöüßàâîïôûùœáúëÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
CER = f"cer AS (SELECT *, levenshtein(t, c)::DOUBLE / length(t) AS cer FROM (SELECT *, {ONE_BYTE.format(CLEAN.format('truth'))} AS t, {ONE_BYTE.format(CLEAN.format('content'))} AS c FROM ({OCR})))"


def _cer(spark, sf_dir):
    plain = table(spark, sf_dir, "benchmark")
    t = F.col("text")
    versions = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("content")) for m, c in (("a", t), ("b", F.translate(t, "eo", "co")), ("c", F.translate(t, "aeiou", "xeoiu")), ("d", F.concat(t, t)))])
    found = plain.select("item_id", (F.col("item_id") % 2).alias("dataset"), F.explode(versions).alias("v")).select("item_id", "dataset", "v.*")
    return evaluate.error_rates(found, plain.select("item_id", F.col("text").alias("truth")), "item_id")


@query(f"WITH {CER} SELECT dataset, model, round_even(avg(cer), 6) AS cer_mean, round_even(median(cer), 6) AS cer_median, round_even(stddev_samp(cer), 6) AS cer_std FROM cer GROUP BY ALL")
def cer_by_model(spark, sf_dir):
    return evaluate.grouped(_cer(spark, sf_dir), ["dataset", "model"], "cer", ["mean", "median", "std"])


def _pivot_sql(f: str) -> str:
    return f"WITH {CER} SELECT dataset, " + ", ".join(f"round_even({f}(cer) FILTER (model = '{m}'), 3) AS {m}" for m in "abcd") + " FROM cer GROUP BY dataset"


for _agg, _f in (("median", "median"), ("mean", "avg"), ("std", "stddev_samp")):
    QUERIES[f"cer_pivot_{_agg}"] = lambda s, d, a=_agg: evaluate.reshape_metrics(_cer(s, d), "cer", "dataset", "model", a, 3, list("abcd"))
    ORACLES[f"cer_pivot_{_agg}"] = _pivot_sql(_f)


@query(f"WITH {CER} SELECT item_id, " + ", ".join(f"max(cer) FILTER (model = '{m}') AS {m}" for m in "abcd") + " FROM cer GROUP BY item_id")
def cer_pivot_unique(spark, sf_dir):
    return evaluate.pivot_unique(_cer(spark, sf_dir), "item_id", "model", "cer", list("abcd"))


@query(f"WITH {CER} SELECT model, threshold, round(avg((cer < threshold)::INT), 9) AS share FROM cer, (SELECT unnest([10, 1, 0.2, 0.1, 0.01]::DOUBLE[]) AS threshold) GROUP BY ALL")
def cer_thresholds(spark, sf_dir):
    return evaluate.below(_cer(spark, sf_dir), "model", "cer").withColumn("share", F.round("share", 9))


@query(f"WITH {CER} SELECT item_id, model, rank() OVER (PARTITION BY item_id ORDER BY cer)::INT AS rank, round(median(cer) OVER (PARTITION BY item_id) - cer, 9) AS deviation FROM cer")
def rank_in_file(spark, sf_dir):
    return evaluate.ranked(_cer(spark, sf_dir), "item_id", "cer").select("item_id", "model", "rank", F.round("deviation", 9).alias("deviation"))


@query(f"WITH {CER} SELECT model, sum((cer = 0)::INT) * 100.0::DOUBLE / (SELECT count(DISTINCT item_id) FROM cer) AS percent FROM cer GROUP BY model")
def no_error_pct(spark, sf_dir):
    return evaluate.error_free_percent(_cer(spark, sf_dir), "model", "item_id")


@query("""
WITH r AS (SELECT source, length(text)::DOUBLE AS t, length(text) * (1 + doc_id % 5 / 10.0::DOUBLE) AS p FROM documents)
SELECT source, round(avg(abs(t - p) / greatest(t, 2.220446049250313e-16::DOUBLE)) * 100, 6) AS mape, round(median(abs(t - p) / t) * 100, 6) AS medape FROM r GROUP BY source
""")
def mape(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.length("text").cast("double").alias("t"), (F.length("text") * (1 + F.col("doc_id") % 5 / 10.0)).alias("p"))
    return evaluate.percentage_errors(rows, "source", "t", "p").select("source", F.round("mape", 6).alias("mape"), F.round("medape", 6).alias("medape"))


DESCRIBE = "count(cer) AS count, round_even(avg(cer), 6) AS mean, round_even(stddev_samp(cer), 6) AS std, min(cer) AS min, round_even(quantile_cont(cer, 0.25), 6) AS q25, round_even(quantile_cont(cer, 0.5), 6) AS q50, round_even(quantile_cont(cer, 0.75), 6) AS q75, max(cer) AS max"


@query(f"WITH {CER} SELECT model, {DESCRIBE} FROM cer GROUP BY model")
def describe_cer(spark, sf_dir):
    return evaluate.describe(_cer(spark, sf_dir), "cer", ["model"])


@query(f"WITH {CER} SELECT {DESCRIBE} FROM cer")
def describe_all(spark, sf_dir):
    return evaluate.describe(_cer(spark, sf_dir), "cer")


@query("SELECT source, n_docs, n_docs = max(n_docs) OVER () AS n_docs_bold FROM (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)")
def extreme_flags(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return evaluate.extreme_flags(counts, ["n_docs"], smallest=False)


# --- labels ---------------------------------------------------------------------------------------------------------
@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN [99] WHEN 3 THEN [quality, toxic + 3] ELSE [quality] END::INT[] AS codes FROM labels
""")
def label_parse(spark, sf_dir):
    q, t = F.col("quality").cast("string"), (F.col("toxic") + 3).cast("string")
    k = F.col("doc_id") % 5
    answer = (
        F.when(k == 0, F.concat(F.lit("{'class': "), q, F.lit("}"))).when(k == 1, F.concat(F.lit('```json\n{"class": '), q, F.lit("}\n```")))
        .when(k == 2, F.concat(F.lit('{ "class" : "'), q, F.lit('" }'))).when(k == 3, F.concat(F.lit("{'class': ["), q, F.lit(", "), t, F.lit("]}"))).otherwise(F.lit("I cannot tell, maybe 3"))
    )
    return table(spark, sf_dir, "labels").select("doc_id", labels.parse_answer(answer).alias("codes"))


_COLLAPSED = " ".join(f"WHEN {k} THEN {v}" for k, v in labels.COLLAPSED.items())
_GENRES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.GENRES.items())
_TYPES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.TEXT_TYPES.items())


@query(f"SELECT doc_id, (doc_id % 8)::INT AS code, CASE doc_id % 8 {_GENRES} END AS genre, CASE doc_id % 8 {_COLLAPSED} ELSE 7 END::INT AS type_code, CASE (CASE doc_id % 8 {_COLLAPSED} END) {_TYPES} END AS type_name FROM labels")
def label_map(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 8).cast("int").alias("code"))
    rows = rows.withColumns({"genre": labels.map_values(F.col("code"), labels.GENRES), "type_code": labels.map_values(F.col("code"), labels.COLLAPSED, keep=True)})
    return rows.withColumn("type_name", labels.map_values(F.col("type_code"), labels.TEXT_TYPES))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1850' || doc_id), doc_id) AS n FROM documents WHERE n_chars > 30) WHERE n <= 10")
def silver_sample(spark, sf_dir):
    return labels.sample_per_group(table(spark, sf_dir, "documents").where("n_chars > 30").select("doc_id", "source"), "source", "doc_id", 10)


@query("""
WITH d AS (SELECT doc_id, lang, source || '-' || doc_id % 7 AS issue FROM documents), i AS (SELECT lang, issue, row_number() OVER (PARTITION BY lang ORDER BY md5('1852' || issue), issue) <= floor(count(*) OVER (PARTITION BY lang) * 0.8::DOUBLE) AS is_train
    FROM (SELECT DISTINCT lang, issue FROM d))
SELECT doc_id, d.lang, d.issue, is_train FROM d JOIN i ON d.lang = i.lang AND d.issue = i.issue
""")
def train_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("issue"))
    return labels.train_split(rows, "issue", "lang")


def _codes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.array((F.col("doc_id") % 18).cast("int"), F.col("quality")).alias("codes"), F.array((F.col("doc_id") % 18).cast("int"), F.col("toxic")).alias("guess"))


CODES = "(SELECT doc_id, [(doc_id % 18)::INT, quality] AS codes, [(doc_id % 18)::INT, toxic] AS guess FROM labels)"


@query(f"SELECT doc_id, {', '.join(f'list_contains(codes, {k})::INT AS class_{k}' for k in range(18))} FROM {CODES}")
def one_hot(spark, sf_dir):
    return labels.one_hot(_codes(spark, sf_dir), "codes", list(range(18))).drop("codes", "guess")


@query("SELECT class, n FROM (" + " UNION ALL ".join(f"SELECT 'class_{k}' AS class, sum(list_contains(codes, {k})::INT)::BIGINT AS n FROM {CODES}" for k in range(18)) + ")")
def class_totals(spark, sf_dir):
    return labels.class_totals(labels.one_hot(_codes(spark, sf_dir), "codes", list(range(18))), list(range(18)))


@query(f"SELECT doc_id, [{', '.join(f'list_contains(codes, {k})::INT' for k in range(18))}] AS vector FROM {CODES}")
def multi_label_vector(spark, sf_dir):
    return _codes(spark, sf_dir).select("doc_id", labels.binarise(F.col("codes"), list(range(18))).alias("vector"))


GUESS = "(SELECT quality AS t, CASE WHEN length(text) > 1000 OR toxic = 1 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"


def _guess(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select(F.col("quality").alias("t"), F.when((F.length("text") > 1000) | (F.col("toxic") == 1), 1).otherwise(0).alias("p"))


@query(f"SELECT t AS true_class, p AS predicted_class, count(*) AS n FROM {GUESS} GROUP BY ALL")
def confusion(spark, sf_dir):
    return labels.confusion(_guess(spark, sf_dir), "t", "p")


def _r(cols: str = "precision, recall, f1") -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols.split(", "))


@query(f"""
WITH g AS (SELECT * FROM {GUESS}), k AS (SELECT k, count(*) FILTER (t = k AND p = k) AS tp, count(*) FILTER (t <> k AND p = k) AS fp, count(*) FILTER (t = k AND p <> k) AS fn FROM g, (SELECT DISTINCT unnest([t, p]) AS k FROM g) GROUP BY k),
e AS (SELECT k::VARCHAR AS label, tp, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tp + fn AS support FROM k), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM e),
a AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f)
SELECT label, {_r()}, support::BIGINT AS support FROM a
""")
def classification_report(spark, sf_dir):
    found = labels.classification_report(_guess(spark, sf_dir), "t", "p")
    return found.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""
WITH k AS (SELECT k AS class, count(*) FILTER (list_contains(codes, k) AND list_contains(guess, k)) AS tp, count(*) FILTER (NOT list_contains(codes, k) AND list_contains(guess, k)) AS fp, count(*) FILTER (list_contains(codes, k) AND NOT list_contains(guess, k)) AS fn,
    avg((list_contains(codes, k) = list_contains(guess, k))::INT) AS accuracy FROM {CODES}, range(18) r(k) GROUP BY k), e AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM k)
SELECT class::INT AS class, {_r('precision, recall')}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, round(accuracy, 9) AS accuracy, (tp + fn)::BIGINT AS support FROM e
""")
def multilabel_metrics(spark, sf_dir):
    found = labels.multilabel_metrics(_codes(spark, sf_dir), "codes", "guess", list(range(18)))
    return found.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "support")


# --- comparison -----------------------------------------------------------------------------------------------------
@query("SELECT source, count(DISTINCT doc_id) AS n_docs, count(DISTINCT lang) AS n_langs, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY source")
def corpus_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.sum(text.char_count(t)).alias("chars"), F.sum(text.line_count(t)).alias("lines"))


LANGS = ["de", "en", "es", "fr", "other"]
PROFILE = "(SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS[:-1]) + ", count(*) FILTER (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) AS other FROM documents GROUP BY source)"


def _profile(spark, sf_dir):
    named = F.when(F.col("lang").isin(*LANGS[:-1]), F.col("lang")).otherwise("other")
    return table(spark, sf_dir, "documents").withColumn("lang", named).groupBy("source").pivot("lang", LANGS).agg(F.count(F.lit(1))).na.fill(0)


@query(f"SELECT * FROM {PROFILE}")
def dataset_info_pivot(spark, sf_dir):
    return _profile(spark, sf_dir)


NORMAL = "(SELECT source, " + ", ".join(f"{x} / (de + en + es + fr + other) AS {x}" for x in LANGS) + f" FROM {PROFILE})"


@query(f"SELECT * FROM {NORMAL}")
def row_normalise(spark, sf_dir):
    return compare.row_normalise(_profile(spark, sf_dir), LANGS)


def _melted(spark, sf_dir):
    return compare.melt(compare.row_normalise(_profile(spark, sf_dir), LANGS), ["source"], LANGS, "topic", "share")


MELTED = f"(UNPIVOT {NORMAL} ON de, en, es, fr, other INTO NAME topic VALUE share)"


@query(f"SELECT source, topic, share FROM {MELTED}")
def topic_melt(spark, sf_dir):
    return _melted(spark, sf_dir)


def _top_sql(order: str) -> str:
    return f"SELECT source, string_agg(topic, ', ' ORDER BY n) AS names FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY share {order}, topic) AS n FROM {MELTED}) WHERE n <= 3 GROUP BY source"


@query(_top_sql("DESC"))
def topic_top3(spark, sf_dir):
    return compare.extremes(_melted(spark, sf_dir), "source", "topic", "share")


@query(_top_sql("ASC"))
def topic_bottom3(spark, sf_dir):
    return compare.extremes(_melted(spark, sf_dir), "source", "topic", "share", largest=False)


@query(f"SELECT x.source AS a, y.source AS b, round(sum(x.share * y.share) / sqrt(sum(x.share * x.share) * sum(y.share * y.share)), 9) AS similarity FROM {MELTED} x JOIN {MELTED} y ON x.topic = y.topic GROUP BY ALL")
def cosine_matrix(spark, sf_dir):
    return compare.cosine_matrix(_melted(spark, sf_dir), "source", "topic", "share").withColumn("similarity", F.round("similarity", 9))


@query()
def ward_linkage(spark, sf_dir):
    import numpy as np

    melted = _melted(spark, sf_dir)
    names = sorted(r.source for r in melted.select("source").distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError("a dendrogram of more than 1,000 sources")
    rows = compare.cosine_matrix(melted, "source", "topic", "share").collect()
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in rows:
        d[at[r.a], at[r.b]] = 1 - r.similarity
    return spark.createDataFrame(compare.ward_linkage(d), "a int, b int, height double, size int")


@query("""
SELECT label, list(m ORDER BY i) AS means, any_value(n) AS n FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 5) AS m, count(*) AS n
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label
""")
def vector_means(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(vectors.round_half_away(F.avg(F.col("x").cast("double")), 5).alias("m"), F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy("label").agg(listed.alias("means"), F.first("n").alias("n"))


@query("""
SELECT vec_id, list_transform(embedding, lambda x: round(1 / (1 + exp(-x::DOUBLE)), 9)) AS p, (list_position(embedding, list_max(embedding)) - 1)::INT AS predicted_class,
    list_transform(embedding, lambda x: (1 / (1 + exp(-x::DOUBLE)) > 0.5)::INT) AS classes FROM embeddings
""")
def model_outputs(spark, sf_dir):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    p = F.transform(wide, lambda x: F.round(vectors.sigmoid(x), 9))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), vectors.argmax(F.col("embedding")).alias("predicted_class"), vectors.multi_label(wide).alias("classes"))


@query("""
WITH m AS (SELECT o_orderpriority AS grp, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT grp, unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM m GROUP BY grp)
SELECT g.grp, last_day(g.m) AS month_end, monthname(g.m) AS month_name, coalesce(n, 0)::BIGINT AS total FROM g LEFT JOIN m ON g.grp = m.grp AND g.m = m.m
""")
def event_months(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return compare.per_month(rows.select(F.col("o_orderpriority").alias("grp"), F.to_date("o_orderdate").alias("day"), F.lit(1).cast("long").alias("n")), "grp", "day", "n")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)apache license|mit license') AND contains(source, '1')")
def event_mentions(spark, sf_dir):
    return compare.mentions(table(spark, sf_dir, "documents"), "text", "apache license|mit license").where(F.contains("source", F.lit("1"))).select("doc_id")


@query("SELECT sum(n_chars)::BIGINT AS n_chars, sum(doc_id)::BIGINT AS doc_id FROM documents")
def column_totals(spark, sf_dir):
    return compare.total_row(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"])


# --- jobs -----------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jobs_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def member_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return jobs.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query("""
SELECT c_custkey AS k, c_name AS name, NULL::VARCHAR AS note FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey > 1000 UNION ALL SELECT c_custkey, upper(c_name), 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <= 1000
""")
def log_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = log.where("k % 3 = 0 AND k <= 1000").select("k", F.upper("name").alias("name"), F.lit("new").alias("note"))
    return jobs.upsert(log.withColumn("note", F.lit(None).cast("string")), new, ["k"])


STATE = "CASE WHEN o_orderkey % 5 = 0 THEN 'exists' WHEN o_orderkey % 7 = 0 THEN 'logged' WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'pending' END"


@query(f"SELECT o_orderkey AS job_id, {STATE} AS state, {STATE} = 'success' AS fetch FROM orders")
def download_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plan = o.select(F.col("o_orderkey").alias("issue"), F.col("o_orderkey").alias("job_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("target_filename"))
    log = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("success").alias("status"))
    remote = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING").alias("remote_status"))
    return jobs.download_status(plan, log, remote, plan.where("job_id % 5 = 0")).select("job_id", "state", "fetch")


@query("""
SELECT d AS dataset, k AS deskew, r AS max_ratio FROM (VALUES ('set_a'), ('set_b')) a(d), (VALUES (true), (false)) b(k), (SELECT unnest([1, 1.5, 2, 1000]::DOUBLE[]) AS r)
""")
def experiment_grid(spark, sf_dir):
    grid = requests.experiment_grid(spark, ["set_a", "set_b"]).select("filename")
    return grid.select(*[c.alias(n) for n, c in requests.parse_experiment(F.col("filename")).items()])


@query("""
SELECT p_partkey || '.png' AS filename, 100 AS height, 200 AS width, 'text' AS class, p_size::DOUBLE AS x1, 2.0::DOUBLE AS y1, p_size + 10.0::DOUBLE AS x2, 7.0::DOUBLE AS y2, 1 AS confidence, p_partkey::VARCHAR AS page_id FROM part
""")
def ndjson_boxes(spark, sf_dir):
    box = F.struct(F.col("p_size").cast("double").alias("left"), F.lit(2.0).alias("top"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"))
    objects = F.array(F.struct(F.lit("text").alias("name"), box.alias("bounding_box")))
    projects = F.create_map(F.lit("p1"), F.struct(F.array(F.struct(F.struct(objects.alias("objects")).alias("annotations"))).alias("labels")))
    line = F.to_json(F.struct(F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("external_id")).alias("data_row"), F.struct(F.lit(100).alias("height"), F.lit(200).alias("width")).alias("media_attributes"), projects.alias("projects")))
    rows = table(spark, sf_dir, "part").select(F.from_json(line, readers.ANNOTATION).alias("r")).select("r.*")
    return readers.boxes_of(rows)


@query("SELECT 'a' AS method, c_custkey AS k, c_acctbal AS v, NULL::VARCHAR AS note FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal, s_name FROM supplier")
def union_methods(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("note"))
    return readers.union_methods({"a": a.withColumn("note", F.lit(None).cast("string")), "b": b}).select("method", "k", "v", "note")


@query("SELECT n_name, r_name, n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, sf_dir):
    dim = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(dim, "n_regionkey", "left").select("n_name", "r_name", "n_nationkey")


@query("SELECT p.p_partkey, p.p_size, p.p_brand, q.p_type FROM part p JOIN (SELECT p_partkey, p_size, p_type FROM part WHERE p_size % 2 = 0) q USING (p_partkey, p_size)")
def natural_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tables.natural_join(part.select("p_partkey", "p_size", "p_brand"), part.where("p_size % 2 = 0").select("p_partkey", "p_size", "p_type"))


@query("""
SELECT a.source, n_issues, chars, de, en, es, fr FROM (SELECT source, count(DISTINCT doc_id) AS n_issues, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source) a
JOIN (SELECT source, """ + ", ".join(f"nullif(count(*) FILTER (lang = '{x}'), 0) AS {x}" for x in LANGS[:-1]) + """ FROM documents GROUP BY source) b ON a.source = b.source
""")
def join_aggregates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    b = tables.count_pivot(docs, "source", "lang", LANGS[:-1])
    sums = [F.countDistinct("doc_id").alias("n_issues"), F.sum(F.length("text")).alias("chars")]
    return tables.join_aggregates(docs, b, ["source"], sums, [F.first(x).alias(x) for x in LANGS[:-1]])


@query("SELECT coalesce(c.k, s.k) AS k, c.v, c.name, s.v AS v_2 FROM (SELECT c_custkey AS k, c_acctbal AS v, c_name AS name FROM customer) c FULL JOIN (SELECT s_suppkey * 2 AS k, s_acctbal AS v FROM supplier) s ON c.k = s.k")
def side_by_side(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name"))
    return tables.side_by_side(a, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def column_selection(spark, sf_dir):
    return tables.columns_like(tables.numeric_columns(table(spark, sf_dir, "part")), "^p_(partkey|size|retailprice)$")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 10")
def head_rows(spark, sf_dir):
    return tables.rows_between(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 10, 50)


@query(f"""
WITH b AS ({synthetic.duck(synthetic.BOXES)}), k AS (SELECT page_id FROM (SELECT DISTINCT page_id FROM b) ORDER BY md5('1850' || page_id), page_id LIMIT 100)
SELECT page_id, box_id FROM b WHERE page_id IN (SELECT page_id FROM k)
""")
def page_sample(spark, sf_dir):
    return tables.page_sample(synthetic.boxes(spark, sf_dir).select(*BOX), "page_id", 100)


@query(f"""
SELECT page_id, box_id, pdf_width, pdf_height, page_width_pt, page_height_pt, round_even(pdf_width / page_width_pt * 72, 2) AS calculated_width_dpi, round_even(pdf_height / page_height_pt * 72, 2) AS calculated_height_dpi,
    round_even(pdf_width / pdf_height, 3) AS image_aspect_ratio, round_even(page_width_pt / page_height_pt, 3) AS page_aspect_ratio, 'assume png' AS image_format
FROM (SELECT page_id, box_id, x2 - x1 AS pdf_width, y2 - y1 AS pdf_height, page_width * 0.5::DOUBLE AS page_width_pt, page_height * 0.25::DOUBLE AS page_height_pt FROM ({synthetic.duck(synthetic.BOXES)}))
""")
def image_metadata(spark, sf_dir):
    rows = synthetic.boxes(spark, sf_dir).select(*BOX, (F.col("x2") - F.col("x1")).alias("pdf_width"), (F.col("y2") - F.col("y1")).alias("pdf_height"), (F.col("page_width") * 0.5).alias("page_width_pt"), (F.col("page_height") * 0.25).alias("page_height_pt"))
    return geometry.image_metadata(rows)


_CHOICES = "; ".join(f"{k}: {v}" for k, v in labels.GENRES.items())


@query(f"""
SELECT doc_id, $$You sort articles of old newspapers by genre and answer with one code. Choose from these classes: {_CHOICES}. Answer as JSON, {{'class': number}}. Text: '''$$ || text || $$''' Example: for '''Sugar rose a penny in Leeds on Monday.''' the answer is {{'class': 0}}.$$ AS prompt FROM documents
""")
def genre_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.genre_prompt(F.col("text")).alias("prompt"))


@query("""
SELECT doc_id::VARCHAR AS custom_id, CASE doc_id % 4 WHEN 0 THEN quality::VARCHAR WHEN 1 THEN '[' || quality || ',4]' END AS class_code, CASE WHEN doc_id % 4 = 1 THEN 'sure' END AS note,
    CASE WHEN doc_id % 4 = 2 THEN quality::VARCHAR END AS value, CASE WHEN doc_id % 4 = 3 THEN 'it''s no answer {' END AS raw_value FROM labels
""")
def answer_columns(spark, sf_dir):
    q, k = F.col("quality").cast("string"), F.col("doc_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("{'class': "), q, F.lit("}"))).when(k == 1, F.concat(F.lit('```json\n{"class": ['), q, F.lit(', 4], "note": "sure"}\n```')))
        .when(k == 2, q).otherwise(F.lit("it's no answer {"))
    )
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("custom_id"), answer.alias("content"))
    return labels.answers_to_columns(rows, ["class", "note"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["article_counts"](spark, sf_dir)
