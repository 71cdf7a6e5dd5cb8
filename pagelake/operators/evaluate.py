"""Evaluation tables: error rates by model, pivots, thresholds, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import character_error_rate, clean_text

AGGREGATES = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def error_rates(found: DataFrame, truth: DataFrame, by: str = "file_name") -> DataFrame:
    """Join on the file and add cer and no_error, both sides cleaned and in lower case."""
    t = truth.select(F.col(by).alias("_by"), F.lower(clean_text(F.col("truth"))).alias("truth"))
    out = found.withColumn("content", F.lower(clean_text(F.col("content")))).join(t, F.col(by) == F.col("_by")).drop("_by")
    out = out.withColumn("cer", character_error_rate(F.col("truth"), F.col("content")))
    return out.withColumn("no_error", F.col("cer") == 0)


def grouped(df: DataFrame, keys: list[str], value: str, aggregates: list[str], digits: int = 6) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.bround(AGGREGATES[a](value).cast("double"), digits).alias(f"{value}_{a}") for a in aggregates])


def reshape_metrics(df: DataFrame, value: str, group: str, spread: str, aggregate: str = "median", digits: int = 3, values: list | None = None) -> DataFrame:
    """Wide table of one aggregate; raises ValueError for an unknown one. Give ``values`` to save a pass."""
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate must be one of {sorted(AGGREGATES)}")
    wide = df.groupBy(group).pivot(spread, values).agg(AGGREGATES[aggregate](value))
    return wide.select(group, *[F.bround(F.col(f"`{c}`").cast("double"), digits).alias(c) for c in wide.columns if c != group])


def pivot_unique(df: DataFrame, index: str, columns: str, value: str, values: list | None = None) -> DataFrame:
    """Wide table without aggregation; a repeated (index, column) pair raises an error."""
    only = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot_unique: repeated entry"))).otherwise(F.max(value))
    return df.groupBy(index).pivot(columns, values).agg(only.cast(df.schema[value].dataType))


def below(df: DataFrame, group: str, value: str, limits: tuple[float, ...] = (10, 1, 0.2, 0.1, 0.01)) -> DataFrame:
    """(group, threshold, share of values below it)."""
    rows = df.select(group, value, F.explode(F.array(*[F.lit(float(x)) for x in limits])).alias("threshold"))
    return rows.groupBy(group, "threshold").agg(F.avg((F.col(value) < F.col("threshold")).cast("double")).alias("share"))


def error_free_percent(df: DataFrame, model: str, file: str = "file_name") -> DataFrame:
    """Files without error per model, in percent of all files of all models."""
    total = df.agg(F.countDistinct(file).alias("files"))  # one row
    sums = df.groupBy(model).agg(F.sum(F.col("no_error").cast("long")).alias("n_free"))
    return sums.crossJoin(F.broadcast(total)).select(model, (F.col("n_free") * 100 / F.col("files")).alias("percent"))


def ranked(df: DataFrame, file: str, value: str) -> DataFrame:
    """Rank in the file (ties share the lower), deviation from the file's median."""
    part = Window.partitionBy(file)
    return df.withColumns({"rank": F.rank().over(part.orderBy(value)), "deviation": F.median(value).over(part) - F.col(value)})


def percentage_errors(df: DataFrame, model: str, truth: str, predicted: str) -> DataFrame:
    """Mean and median absolute percentage error; the mean guards a zero truth, the median gives infinity."""
    diff = F.abs(F.col(truth) - F.col(predicted)).cast("double")
    mape = F.avg(diff / F.greatest(F.abs(F.col(truth)).cast("double"), F.lit(2.220446049250313e-16))) * 100
    ratio = F.when(F.col(truth) != 0, diff / F.abs(F.col(truth))).when(diff > 0, F.lit(float("inf"))).otherwise(0.0)
    return df.groupBy(model).agg(mape.alias("mape"), (F.median(ratio) * 100).alias("medape"))


def describe(df: DataFrame, value: str, keys: list[str] | None = None, digits: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles, max."""
    v = F.col(value).cast("double")
    q = lambda p, name: F.bround(F.percentile(v, p), digits).alias(name)
    return df.groupBy(*(keys or [])).agg(
        F.count(v).alias("count"), F.bround(F.avg(v), digits).alias("mean"), F.bround(F.stddev_samp(v), digits).alias("std"), F.min(v).alias("min"),
        q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max(v).alias("max"),
    )


def extreme_flags(df: DataFrame, columns: list[str], smallest: bool = True) -> DataFrame:
    """For tables: <column>_bold where the value is the column's extreme."""
    best = df.agg(*[(F.min if smallest else F.max)(c).alias(f"_{c}") for c in columns])  # one row
    return df.crossJoin(F.broadcast(best)).select(*df.columns, *[(F.col(c) == F.col(f"_{c}")).alias(f"{c}_bold") for c in columns])


def latex(df: DataFrame, columns: list[str], smallest: bool = True) -> str:
    """A small result table as LaTeX, extremes in bold."""
    rows = extreme_flags(df, columns, smallest).collect()
    cell = lambda r, c: f"\\textbf{{{r[c]}}}" if c in columns and r[f"{c}_bold"] else str(r[c])
    body = " \\\\\n".join(" & ".join(cell(r, c) for c in df.columns) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(df.columns)} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}"
