"""Labels: prompts, parsing of answers, samples, splits, encodings and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Genre codes and what they collapse to.
GENRES = {0: "news report", 1: "editorial", 2: "letter", 3: "advert", 4: "review", 5: "poem/song/story", 6: "other"}
COLLAPSED = {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 2, 6: 3}
TEXT_TYPES = {0: "article", 1: "advert", 2: "poem/song/story", 3: "other"}
#: Topic codes.
TOPICS = {
    0: "arts_culture_entertainment_media",
    1: "crime_law_justice",
    2: "disaster_accident_emergency",
    3: "economy_business_finance",
    4: "education",
    5: "environment",
    6: "health",
    7: "human_interest",
    8: "labour",
    9: "lifestyle_leisure",
    10: "politics",
    11: "religion",
    12: "science_technology",
    13: "society",
    14: "sport",
    15: "conflict_war_peace",
    16: "weather",
    17: "NA",
}
FAILED = 99


def map_values(c: Column, table: dict, keep: bool = False) -> Column:
    """Look up; what is not in the table is null, or kept."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, c) if keep else found


def prompt(text: Column, names: dict[int, str], task: str) -> Column:
    """A classification prompt around a text."""
    listed = "; ".join(f"{k}: {v}" for k, v in names.items())
    return F.concat(F.lit(f"{task} Choose from these classes: {listed}. Answer as JSON, {{'class': number}}. Text: '''"), text, F.lit("'''"))


def _shown(name: str) -> str:
    """A topic's name as the model is shown it."""
    words = name.split("_")
    return name if len(words) == 1 else ", ".join(words[:-1]) + f" and {words[-1]}"


def genre_prompt(text: Column) -> Column:
    """Ask for one genre code of an article, with a worked example."""
    example = " Example: for '''Sugar rose a penny in Leeds on Monday.''' the answer is {'class': 0}."
    return F.concat(prompt(text, GENRES, "You sort articles of old newspapers by genre and answer with one code."), F.lit(example))


def topic_prompt(text: Column) -> Column:
    """Ask for one or more topic codes of an article, with a worked example."""
    names = {k: _shown(v) for k, v in TOPICS.items()}
    example = " Example: for '''The school at Hull is shut while fever lasts.''' the answer is {'class': [4, 6]}."
    return F.concat(prompt(text, names, "You sort articles of old newspapers by topic and answer with every code that fits."), F.lit(example))


def answers_to_columns(df: DataFrame, names: list[str], answer: str = "content", key: str = "custom_id") -> DataFrame:
    """One row per answer: key, the named entries of its dictionary (``class`` as class_code), value, raw_value.

    Answers are dictionaries in JSON or with single quotes, fenced or not. What
    parses but is no dictionary goes to ``value``; what does not parse goes to
    ``raw_value`` as it is. Entries are text: numbers as written, lists as JSON.
    """
    body = F.btrim(F.replace(F.replace(F.col(answer), F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit("")), F.lit(" \n\t"))
    json = F.when(F.contains(body, F.lit('"')), body).otherwise(F.replace(body, F.lit("'"), F.lit('"')))
    rows = df.select(key, F.col(answer).alias("_raw"), json.alias("_json"))
    # only an object has keys; [x] is an array of one if and only if x is one value
    rows = rows.withColumns({"_keys": F.json_object_keys("_json"), "_one": F.coalesce(F.json_array_length(F.concat(F.lit("["), "_json", F.lit("]"))) == 1, F.lit(False))})
    named = [F.get_json_object("_json", f"$.{n}").alias("class_code" if n == "class" else n) for n in names]
    return rows.select(
        key, *named, F.when(F.col("_keys").isNull() & F.col("_one"), F.col("_json")).alias("value"),
        F.when(F.col("_keys").isNull() & ~F.col("_one"), F.col("_raw")).alias("raw_value"),
    )


def parse_answer(answer: Column) -> Column:
    """Class codes in an answer that may be fenced, quoted either way, a number or a list; [99] where there are none.

    Nothing of the answer is ever evaluated.
    """
    body = F.regexp_replace(F.regexp_replace(answer, r"^[`json\s]+", ""), r"[\s`]+$", "")
    tail = F.regexp_extract(F.regexp_replace(F.regexp_replace(body, "'", '"'), r"\s+", ""), r'^\{"class":(.*)\}$', 1)
    codes = F.transform(F.regexp_extract_all(tail, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(FAILED)))


def hash_order(key: Column, seed: int | str) -> Column:
    """A reproducible shuffled order."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 1850) -> DataFrame:
    """n rows of each group; the same rows every time."""
    along = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_nth", F.row_number().over(along)).where(F.col("_nth") <= n).drop("_nth")


def train_split(df: DataFrame, issue: str, group: str, share: float = 0.8, seed: int = 1852) -> DataFrame:
    """is_train for ``share`` of each group's issues, never parting an issue."""
    issues = df.select(group, issue).distinct()
    part = Window.partitionBy(group)
    nth = F.row_number().over(part.orderBy(hash_order(F.col(issue), seed), issue))
    issues = issues.select(F.col(group).alias("_g"), F.col(issue).alias("_i"), (nth <= F.floor(F.count(F.lit(1)).over(part) * share)).alias("is_train"))
    return df.join(issues, df[group].eqNullSafe(F.col("_g")) & (df[issue] == F.col("_i"))).drop("_g", "_i")


def one_hot(df: DataFrame, codes: str, classes: list[int], prefix: str = "class_") -> DataFrame:
    return df.select("*", *[F.array_contains(codes, k).cast("int").alias(f"{prefix}{k}") for k in classes])


def class_totals(df: DataFrame, classes: list[int], prefix: str = "class_") -> DataFrame:
    """(class, n) from one-hot columns, largest first."""
    sums = df.agg(*[F.sum(f"{prefix}{k}").alias(f"{prefix}{k}") for k in classes])
    return sums.unpivot([], [f"{prefix}{k}" for k in classes], "class", "n").orderBy(F.desc("n"), "class")


def binarise(codes: Column, classes: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in classes]), lambda k: F.array_contains(codes, k).cast("int"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))


def _scores(df: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))
    df = df.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return df.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class precision, recall, f1, support; then accuracy, macro avg and weighted avg."""
    pairs = confusion(df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()), truth, predicted)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("true_class").alias("class"), F.when(F.col("true_class") == F.col("predicted_class"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("true_class") != F.col("predicted_class"), F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp")),
        F.struct(F.col("predicted_class").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.when(F.col("true_class") != F.col("predicted_class"), F.col("n")).otherwise(0).alias("fp")),
    )).alias("s")).select("s.*")
    each = _scores(sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))).withColumn("support", F.col("tp") + F.col("fn"))
    rows = each.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    acc = each.agg((F.sum("tp") / total).alias("a"), total.alias("support")).select(F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return rows.unionByName(macro).unionByName(weighted).unionByName(acc)


def multilabel_metrics(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Per class scores from arrays of codes, with elementwise accuracy."""
    each = df.select(F.explode(F.array(*[F.lit(k) for k in classes])).alias("class"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    each = each.select("class", F.array_contains("t", F.col("class")).alias("t"), F.array_contains("p", F.col("class")).alias("p"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    t, p = F.col("t"), F.col("p")
    found = each.groupBy("class").agg(n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"), F.avg((t == p).cast("double")).alias("accuracy"))
    return _scores(found).select("class", "precision", "recall", "f1", "accuracy", (F.col("tp") + F.col("fn")).alias("support"))
