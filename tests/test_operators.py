"""Hand-derived cases and properties of the operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.adapters import image_steps, infer, rendered_pages, retrying, stub_classifier, stub_renderer, stub_step
from pagelake.functions import geometry, ids, text
from pagelake.functions.knit import knit, knit_all
from pagelake.operators import articles, compare, coverage, evaluate, jobs, labels, layout, requests, tables
from pagelake.plans import queries, synthetic
from pagelake.sources import readers, remote, writers
from tests.helpers import DATA


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("exam-\nple line\nnext\n\n\npara  two", "example line next\n\npara two"), ("", ""), ("\n \n", "")])
def test_clean_text(spark, raw, want):
    assert value(spark, text.clean_text(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("THE LEADER.", True), ("NO. 5", False), ("RHYTHM", False), ("The Leader", False), ("A B C D E", True)])
def test_is_title(spark, raw, want):
    assert value(spark, text.is_title(F.lit(raw))) is want


def test_fence_and_case(spark):
    assert value(spark, text.fence_strip(F.lit("`tsv a tsv`"))) == " a tsv"
    assert value(spark, text.title_case(F.lit("arts/enter foo's"))) == "Arts/Enter Foo'S"
    assert value(spark, text.word_count(F.lit("  a b\n"))) == 2
    assert value(spark, text.word_count(F.lit(" "))) == 0


def test_knit(spark):
    parts = ["Hello world", "world of Python", "Python is great"]
    assert knit_all(parts) == "Hello world of Python is great"
    assert value(spark, knit(F.array(*map(F.lit, parts)))) == "Hello world of Python is great"
    assert knit_all(["ab", "cd"]) == "abcd"


def test_split_plan(spark):
    got = value(spark, geometry.split_plan(F.lit(100), F.lit(400)))
    assert [(s.y0, s.y1) for s in got] == [(0, 150), (120, 270), (240, 390), (250, 400)]
    assert len(value(spark, geometry.split_plan(F.lit(100), F.lit(150)))) == 1


def test_custom_id(spark):
    c = F.lit("CLD-1850-04-20_page_10_text_B0C2R4_segment_0")
    got = value(spark, F.struct(*[v.alias(k) for k, v in ids.decompose(c).items()]))
    assert tuple(got) == ("CLD-1850-04-20", 10, "text", 0, 2, 4, 0)
    again = ids.custom_id(F.lit("CLD-1850-04-20_page_10"), F.lit("text"), ids.box_page_id(F.lit(0), F.lit(2), F.lit(4)), F.lit(0))
    assert value(spark, again) == "CLD-1850-04-20_page_10_text_B0C2R4_segment_0"


def boxes(spark, rows, page="p_page_1"):
    data = [(page, f"{page}.png", k, c, 0.9, float(x1), float(y1), float(x2), float(y2)) for k, (c, x1, y1, x2, y2) in enumerate(rows)]
    return spark.createDataFrame(data, "page_id string, filename string, box_id int, class string, confidence double, x1 double, y1 double, x2 double, y2 double")


def test_coverage_golden(spark):
    df = boxes(spark, [("text", 0, 0, 6, 10), ("text", 4, 0, 10, 5), ("figure", 8, 5, 10, 10)])
    r = coverage.page_coverage(layout.print_area(df)).first()
    assert (r.text_overlap_pixels, r.text_coverage_pixels, r.text_image_overlap, r.total_covered_pixels, r.total_overlap) == (10, 80, 0, 90, 10)
    assert (r.perc_print_area_overlap, r.perc_print_area_coverage) == (0.1, 0.9)


def test_coverage_against_pixels(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        x, y = rng.randint(0, 30), rng.randint(0, 30)
        rows.append((rng.choice(["text", "figure"]), x, y, x + rng.randint(0, 15), y + rng.randint(0, 15)))
    r = coverage.page_coverage(layout.print_area(boxes(spark, rows))).first()
    x0, y0 = min(b[1] for b in rows), min(b[2] for b in rows)
    t, f = np.zeros((60, 60), int), np.zeros((60, 60), int)
    for c, x1, y1, x2, y2 in rows:
        (f if c == "figure" else t)[y1 - y0 : y2 - y0, x1 - x0 : x2 - x0] += 1
    assert r.text_coverage_pixels == (t > 0).sum() and r.text_overlap_pixels == (t > 1).sum()
    assert r.text_image_overlap == ((t > 0) & (f > 0)).sum() and r.total_overlap == (t + f > 1).sum()


def test_assign_columns(spark):
    df = boxes(spark, [("text", 10, 0, 40, 5), ("text", 45, 0, 95, 5), ("text", 46, 0, 96, 5), ("text", 0, 0, 100, 5)])
    df = layout.print_area(df).withColumn("column_counts", F.lit(2.0))
    assert [r.column_number for r in layout.assign_columns(df).orderBy("box_id").collect()] == [1, 0, 2, 0]


def test_adjust_y2(spark):
    df = boxes(spark, [("text", 0, 0, 9, 12), ("text", 0, 10, 9, 15), ("text", 0, 30, 9, 40)]).withColumns({"page_block": F.lit(0), "column_number": F.lit(1)})
    assert [r.y2 for r in layout.adjust_y2(df).orderBy("y1").collect()] == [10, 30, 40]


def test_page_blocks(spark):
    rows = [("text", 0, 5, 9, 8), ("title", 0, 10, 9, 12), ("text", 0, 20, 9, 25), ("title", 0, 50, 9, 52), ("text", 0, 70, 9, 75)]
    df = boxes(spark, rows).withColumn("column_number", F.when(F.col("class") == "title", 0).otherwise(1)).withColumn("center_y", F.col("y2"))
    assert [r.page_block for r in layout.page_blocks(df).orderBy("box_id").collect()] == [0, 1, 1, 2, 2]


def test_abandon_line(spark):
    rows = [("text", 0, 0, 9, 11), ("abandon", 0, 5, 9, 12), ("text", 0, 6, 9, 13), ("text", 0, 90, 9, 100)]
    got = layout.reclassify_abandon(layout.basic_box_data(boxes(spark, rows))).orderBy("box_id").collect()
    assert [r["class"] for r in got] == ["abandon", "abandon", "text", "text"]


def test_postprocess_properties(spark):
    df = layout.postprocess(layout.normalise_class(synthetic.boxes(spark, DATA))).cache()
    bad = df.groupBy("page_id").agg(F.sort_array(F.collect_list("reading_order")).alias("o")).where(F.col("o") != F.sequence(F.lit(1), F.size("o")))
    assert bad.count() == 0
    # boxes that fill gaps take their sides from a neighbour, which may be a figure
    assert df.where("class <> 'figure' AND x1 > c1 AND box_id >= 0").count() == 0


def frame(spark, rows, issue="i", page="i_page_1", box="B0C1R1"):
    data = [(issue, page, box, c, t, 1, n, 1) for n, (c, t) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "issue_id string, page_id string, box_page_id string, class string, content string, reading_order int, sub_order int, frame_pos int")


@pytest.mark.parametrize("mode, want", [("compat", ["A\nB", "C", "D"]), ("documented", ["A", "B\nC", "D"])])
def test_merge_titles(spark, mode, want):
    df = frame(spark, [("text", "A"), ("title", "B"), ("title", "C"), ("text", "D")])
    got = articles.merge_consecutive_titles(df, mode).orderBy("reading_order").collect()
    assert [r.content for r in got] == want and [r.sub_order for r in got] == [1, 2, 3]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("text", "a"), ("title", "T"), ("text", "b"), ("text", "c")], [(None, "a"), ("T", "T\n\nb\n\nc")]),
        ([("title", "T1"), ("title", "T2"), ("text", "x")], [(None, ""), ("T2", "T2\n\nx")]),
        ([("title", "T"), ("text", "x")], [("T", "T\n\nx")]),
    ],
)
def test_create_articles(spark, rows, want):
    got = articles.create_articles(frame(spark, rows)).orderBy("reading_order").collect()
    assert [(r.title, r.content) for r in got] == want


def test_article_pages_are_ordered_as_text(spark):
    a, b = frame(spark, [("text", "two")], page="X_page_2"), frame(spark, [("text", "ten")], page="X_page_10")
    assert articles.create_articles(a.unionByName(b)).first().content == "ten\n\ntwo"


def test_null_and_empty_contents(spark):
    df = frame(spark, [("text", None), ("text", ""), ("text", "x\n\n\n\ny")]).withColumn("frame_pos", F.col("sub_order")).drop("sub_order")
    assert [r.content for r in articles.split_and_reclassify(df).orderBy("frame_pos", "sub_order").collect()] == [None, "x", "y"]


def test_labels(spark):
    parse = lambda s: value(spark, labels.parse_answer(F.lit(s)))
    assert parse("```json\n{'class': [3, 4]}\n```") == [3, 4]
    assert parse('{"class": 2}') == [2] and parse("__import__('os')") == [99]


def test_months_without_rows_are_zero(spark):
    df = spark.createDataFrame([("a", "1851-01-05", 1), ("a", "1851-03-08", 1)], "g string, d string, n int").withColumn("d", F.to_date("d"))
    got = compare.per_month(df, "g", "d", "n").orderBy("month_end").collect()
    assert [(r.month_name, r.total) for r in got] == [("January", 1), ("February", 0), ("March", 1)]


def test_ward(spark):
    points = np.array([0.0, 1.0, 10.0, 11.0, 50.0])
    merges = compare.ward_linkage(np.abs(points[:, None] - points[None, :]))
    assert {merges[0][:2], merges[1][:2]} == {(0, 1), (2, 3)} and merges[-1][3] == 5


def test_errors_raise(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "i int, m string, v double")
    with pytest.raises(ValueError):
        evaluate.reshape_metrics(df, "v", "i", "m", "nonsense")
    with pytest.raises(Exception, match="repeated entry"):
        evaluate.pivot_unique(df, "i", "m", "v").collect()
    assert "textbf" in evaluate.latex(df, ["v"])


def test_pipeline_state():
    runs = []
    stage = lambda n, *needs: jobs.Stage(n, lambda done, n=n: runs.append(n), needs)
    state = jobs.PipelineState([stage("a"), stage("b", "a"), stage("c", "b")], {"a": 1})
    state.resume()
    assert runs == ["b", "c"] and state.next() is None


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("line 1\nline 2")
    (tmp_path / "t" / "skip.md").write_text("no")
    assert [tuple(r) for r in readers.text_folder(spark, str(tmp_path / "t")).collect()] == [("one", "line 1\nline 2")]
    body = {"usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}, "choices": [{"finish_reason": "stop", "message": {"content": "é"}}]}
    (tmp_path / "r.json").write_text(json.dumps([{"id": "1", "custom_id": "c", "response": {"body": body}}]))
    assert readers.json_array(spark, str(tmp_path / "r.json")).first().response.body.choices[0].message.content == "é"
    df = spark.createDataFrame([("x", 1), ("y", 2)], "periodical string, n int")
    out = str(tmp_path / "out")
    assert not writers.exists(spark, out)
    writers.parquet(df, out)
    assert writers.exists(spark, out) and readers.tagged_parquet(spark, out).count() == 2
    writers.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "periodical string, n int").count() == 2


def test_requests(spark):
    rows = spark.createDataFrame([("c1", "table", "AA==")], "custom_id string, class string, image string")
    got = json.loads(requests.image_lines(rows).first().value)
    assert got["custom_id"] == "c1" and "table" in got["body"]["messages"][0]["content"][0]["text"]


def test_adapters(spark):
    df = spark.createDataFrame([("u", "abc")], "bbox_uid string, content string")
    schema = "bbox_uid string, predicted_class long, class_0_probability double, class_1_probability double"
    assert infer(df, stub_classifier(2), schema).first().predicted_class == 1
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return batch

    assert retrying(flaky, wait=0)(df) is df and len(calls) == 3


def test_stream(spark, tmp_path):
    from pagelake.streaming.responses import segments, write_segments

    (tmp_path / "in").mkdir()
    body = {"usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}, "choices": [{"finish_reason": "stop", "message": {"content": "x"}}]}
    line = json.dumps({"id": "1", "custom_id": "A-1850-01-01_page_1_text_B0C1R2_segment_0", "response": {"body": body}})
    (tmp_path / "in" / "a.jsonl").write_text(line + "\nbroken\n")
    write_segments(segments(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.issue_id, r.reading_order, r.content) for r in rows] == [("A-1850-01-01", 2, "x")]


def test_ward_against_centroids():
    """On points, Ward's height is sqrt(2 |A| |B| / (|A| + |B|)) times the distance of the centroids."""
    rng = np.random.default_rng(3)
    for n in (2, 5, 9):
        points = rng.normal(size=(n, 3))
        d = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(axis=2))
        groups, want = {i: [i] for i in range(n)}, []
        for new in range(n, 2 * n - 1):
            def height(a, b):
                p, q = points[groups[a]], points[groups[b]]
                return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(axis=0) - q.mean(axis=0)) ** 2).sum())

            i, j = min(((a, b) for a in groups for b in groups if a < b), key=lambda ab: height(*ab))
            want.append((i, j, height(i, j), len(groups[i]) + len(groups[j])))
            groups[new] = groups.pop(i) + groups.pop(j)
        got = compare.ward_linkage(d)
        assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_error_rate_counts_code_points(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = random.Random(5)
    rows = [("".join(rng.choice("aäß🙂 é") for _ in range(rng.randint(1, 12))), "".join(rng.choice("aäß🙂 é") for _ in range(rng.randrange(12)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, f string").select("t", "f", text.character_error_rate(F.col("t"), F.col("f")).alias("r")).collect()
    assert all(r.r == pytest.approx(edits(r.t, r.f) / len(r.t)) for r in got)


def test_jobs_go_on_from_the_log(spark, tmp_path):
    wanted = spark.createDataFrame([(f"i{k}",) for k in range(10)] + [("i3",)], "issue string")
    log, seen = str(tmp_path / "log"), []

    def submit(rows, broken=True):
        seen.extend(r.issue for r in rows)
        if broken and len(seen) > 6:
            raise RuntimeError("the service is down")
        return [(r.issue, f"job-{r.issue}") for r in rows if r.issue != "i0"]

    with pytest.raises(RuntimeError):
        jobs.submit_pending(wanted, log, "issue", submit, 3)
    done = {r.issue for r in spark.read.parquet(log).collect()}
    seen.clear()
    assert jobs.submit_pending(wanted, log, "issue", lambda rows: submit(rows, False), 3) == 9 - len(done)
    assert not done & set(seen) and len(seen) == 10 - len(done)
    assert {r.issue for r in spark.read.parquet(log).collect()} == {f"i{k}" for k in range(1, 10)}


def test_stages_skip_what_is_there(spark, tmp_path):
    made = []

    def stage(name):
        def run(done):
            made.append(name)
            return spark.range(3)

        return run

    def state():
        return jobs.PipelineState([jobs.Stage("a", stage("a"), path=str(tmp_path / "a")), jobs.Stage("b", stage("b"), ("a",), str(tmp_path / "b"))], spark=spark)

    assert state().resume()["b"].count() == 3 and made == ["a", "b"]
    assert state().resume()["b"].count() == 3 and made == ["a", "b"]
    (tmp_path / "b" / "_SUCCESS").unlink()  # half written
    assert state().resume()["b"].count() == 3 and made == ["a", "b", "b"]


def test_remote_files_and_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"one\x0ctwo")
    assert remote.copy(spark, str(tmp_path / "in"), str(tmp_path / "out")) and not remote.copy(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "out"))
    pages = rendered_pages(files, stub_renderer)
    assert sorted((r.name, r.page, bytes(r.image)) for r in pages.collect()) == [("x_page_0", 0, b"one"), ("x_page_1", 1, b"two")]
    done = image_steps(pages, [stub_step, lambda data, row: data + row["name"].encode()])
    writers.encoded_images(done.select(F.col("name").alias("custom_id"), F.base64("image").alias("image")), str(tmp_path / "png"))
    assert (tmp_path / "png" / "x_page_1.png").read_bytes() == b"twox_page_1"
    assert remote.delete(spark, str(tmp_path / "png" / "*.png"), 1) == 2 and remote.delete(spark, str(tmp_path / "png" / "*.png")) == 0


def test_tables(spark):
    a, b = spark.createDataFrame([(1, "x", 2.0)], "k int, name string, prob double"), spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, name string, n int")
    assert tables.natural_join(a, b).collect()[0].asDict() == {"k": 1, "name": "x", "prob": 2.0, "n": 5}
    with pytest.raises(ValueError):
        tables.natural_join(a.select("prob"), b)
    assert tables.side_by_side(a, b, ["k"]).columns == ["k", "name", "prob", "name_2", "n"]
    assert tables.columns_like(a, "prob|k").columns == ["k", "prob"] and tables.columns_like(a, "prob$", keep=False).columns == ["k", "name"] and tables.numeric_columns(a).columns == ["k", "prob"]
    assert [r.id for r in tables.rows_between(spark.range(10), ["id"], 3, 6).collect()] == [3, 4, 5]


def test_prompts(spark):
    assert "5: environment" in value(spark, labels.topic_prompt(F.lit("x"))) and "15: conflict, war and peace" in value(spark, labels.topic_prompt(F.lit("x")))
    assert "'''x'''" in value(spark, labels.genre_prompt(F.lit("x"))) and "6: other" in value(spark, labels.genre_prompt(F.lit("x")))


def exchanges(df, kind="Exchange hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(kind)


def test_boxes_are_dealt_once_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "ROWS_A_TASK", 500)
    df = synthetic.boxes(spark, DATA)
    assert df.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert exchanges(layout.reading_order(layout.collapse_class(layout.assign_columns(layout.basic_box_data(layout.add_issue(df)))))) == 1


def test_coverage_makes_no_row_per_slab(spark):
    df = coverage.page_coverage(layout.basic_box_data(synthetic.boxes(spark, DATA)))
    assert "Generate explode" not in df._jdf.queryExecution().executedPlan().toString().split("collect_list")[0]


def test_coverage_of_a_page_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    a, c = rng.integers(0, 40, (2, 1, 60))
    b, d = a + rng.integers(1, 12, (1, 60)), c + rng.integers(1, 12, (1, 60))
    fig = rng.random((1, 60)) < 0.3
    t, f = np.zeros((60, 60), int), np.zeros((60, 60), int)
    for k in range(60):
        (f if fig[0, k] else t)[a[0, k] : b[0, k], c[0, k] : d[0, k]] += 1
    want = [int(x.sum()) for x in (t > 0, t > 1, (t > 0) & (f > 0), t + f > 0, t + f > 1)]
    for cells in (1, 500, 1_000_000):
        monkeypatch.setattr(coverage, "CELLS", cells)
        assert coverage._areas(a, b, c, d, fig)[0].tolist() == want


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_gaps_are_filled_without_sorting(spark):
    widened = queries._widened(spark, DATA)
    assert sorts(layout.fill_column_gaps(widened)) == sorts(widened)


def test_min_height_sorts_no_rows(spark):
    # lines, equal boxes, reading order, the next box of a column; none for the gaps
    assert sorts(queries.QUERIES["min_height"](spark, DATA)) == 4


def test_new_boxes_of_a_page(spark):
    rows = [("p", "p_page_1.png", "p", 1, "text", 1, 1, 0, 0.0, 40.0, 10.0, 20.0), ("p", "p_page_1.png", "p", 2, "text", 2, 2, 0, 50.0, 120.0, 0.0, 90.0), ("p", "p_page_1.png", "p", 3, "text", 3, 3, 0, 130.0, 200.0, 0.0, 100.0)]
    kind = "page_id string, filename string, issue string, box_id int, class string, column_number int, reading_order int, page_block int, x1 double, x2 double, y1 double, y2 double"
    more = "c1 c2 median_box_width print_x1 print_y1 print_x2 print_y2 column_width".split()
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit(-5.0) for c in more})
    new = layout.fill_column_gaps(df).where("box_id < 0").orderBy("column_number", "y1").collect()
    assert [(r.box_id, r.column_number, r.x1, r.x2, r.y1, r.y2) for r in new] == [(-2, 1, 0, 40, 0, 10), (-1, 1, 0, 40, 20, 100), (-1, 2, 50, 120, 90, 100)]
    # widths 40, 40 and 70: a box with two neighbours counts twice
    assert {(r.median_box_width, r.print_x1, r.print_y1, r.print_x2, r.print_y2, r.column_width) for r in new} == {(40, 0, 0, 120, 100, 40)}


def test_boxes_are_sorted_once(spark):
    assert sorts(queries.QUERIES["box_basic"](spark, DATA)) == 1


def test_reading_order_sorts(spark):
    assert sorts(queries.QUERIES["reading_order"](spark, DATA)) == 3  # lines, equal boxes, reading order


def test_adjust_y2_sorts(spark):
    assert sorts(queries.QUERIES["adjust_y2"](spark, DATA)) == 3  # lines, equal boxes, the next box of a column


def test_copies_of_equal_lines(spark, tmp_path):
    line = (8, 1, 17, 3, 5.0, 10.0, 0.1, "N")
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    spark.createDataFrame([line, line, (8, 2, 18, *line[3:]), (8, 3, 34, *line[3:])], kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = synthetic.boxes(spark, str(tmp_path)).collect()
    assert sorted(r.box_id for r in found) == [1, 2, 3, 4, 1001, 1002, 1004]
    assert {r.box_id: r.confidence for r in found}[1004] == pytest.approx(0.89)
