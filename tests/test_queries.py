"""Every query of the engine against its SQL, on the smallest tables."""

import difflib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake.functions import text
from pagelake.functions.knit import longest_shared
from pagelake.plans import queries
from tests.helpers import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    same(queries.QUERIES[name](spark, DATA), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).limit(5).collect()


def test_vector_means_small_negative(spark, tmp_path):
    rows = [(1, [-1e-6, 1.005e-5, -0.25], 1), (2, [-1e-6, 1.0e-5, 0.25], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.vector_means(spark, str(tmp_path)).collect()[0].means
    sql = queries.ORACLES["vector_means"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert [repr(x) for x in got] == [repr(x) for x in duckdb.connect().sql(sql).fetchall()[0][1]]
    assert repr(got[0]) == "-0.0"


def test_segments_knit_whole_texts(spark):
    rng = random.Random(1)
    texts = {k: "".join(rng.choice("abcdefg hij") for _ in range(n)) for k, n in enumerate((0, 1, 20, 299, 300, 301, 550, 551, 1051, 2600))} | {10: "ab" * 900, 11: None}
    want = {}
    for k, t in texts.items():
        out = None
        for s in range(0, max(1, len(t or "") - 50), 250):
            part = (t or "")[s : s + 300]
            m = difflib.SequenceMatcher(None, out or "", part, autojunk=False).find_longest_match()
            out = part if out is None else out + part if m.size == 0 else out[: m.a] + part[m.b :]
        want[k] = out
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.reading_order: r.content for r in queries._segments_knit(docs).collect()}
    assert {k: v or "" for k, v in got.items()} == want and got[9] == texts[9]


def test_longest_shared_is_difflibs():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(2))
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        got = longest_shared(a, b)
        assert got[2] == m.size and (not m.size or got == (m.a, m.b, m.size))


def test_longest_shared_searches_long_texts_seldom():
    class Counted(str):
        calls = 0

        def __contains__(self, part):
            Counted.calls += 1
            return str.__contains__(self, part)

        def find(self, *args):
            Counted.calls += 1
            return str.find(self, *args)

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ij") for _ in range(5250))
    assert longest_shared(Counted(text[:5050]), text[5000:]) == (5000, 0, 50)
    assert Counted.calls < 30


def test_reading_ease_odd_texts(spark):
    rows = [("The nth hymn. Be!?", 206.835 - 1.015 * 2 - 84.6), ("\u212aE... \u00e9 1", 206.835 - 1.015 - 84.6), ("12 \u00e9.", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want double").select("want", text.reading_ease(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got if r.want is None else abs(r.want - r.got) < 1e-9 for r in got), got


def test_reading_ease_has_no_call_per_word(spark):
    plan = queries.reading_ease(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1


def test_merging_gathers_no_rows_and_pages_move_once_more_at_most(spark):
    for name, most in (("merge_boxes", 1), ("merge_overlapping_boxes", 1), ("postprocess_bbox", 2), ("request_plan", 2)):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most and "collect_list(struct" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
