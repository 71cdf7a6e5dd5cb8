"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import (
    exact_dedup,
    license_scan,
    mixing,
    pieces,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_output,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    table, bias = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, table, bias)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_lines", "lost_share",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.model_bytes(spark, tokenizer_path("piece_bpe_32k.model"))
    return pieces.encode(_table(spark, sf_dir, "documents"), model)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.annotate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    table, lengths = token_output.write(_table(spark, sf_dir, "documents"), definition)
    return token_output.read(table, lengths, token_output.crc_of_ids, "ids_crc32 long")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        F.when(F.col("text").isNull(), 16).otherwise(F.octet_length("text") + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    dims = {c: F.col(c) for c in ("source", "lang", "size")}
    return sharding.shard(docs, dims).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=False)
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_binary_output": op6_token_binary_output,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_R = quality_rules.LineRules()
_Q = quality_rules


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(m.x, '{pattern}'))"


_BOILERPLATE = _Q.BOILERPLATE.replace("'", "''")
_LINE = f"""m.n = 0 OR NOT (
    {_n(_Q.ODD)} > m.n * {_R.max_symbols_per_word}::DOUBLE + 2
    OR (length(m.x) - length(replace(m.x, '!!', ''))) / 2.0::DOUBLE > m.n * {_R.max_shouts_per_word}::DOUBLE + 1
    OR (m.n >= {_R.unmarked_words} AND punctuated AND NOT regexp_matches(m.x, '{_Q.MARKS}'))
    OR (m.n >= {_R.capital_words} AND NOT regexp_matches(m.x, '{_Q.SMALL}') AND regexp_matches(m.x, '{_Q.CAPITALS}'))
    OR ({_n(_Q.SEPARATORS)} >= 2 AND {_n(_Q.SEPARATORS)} > m.n * {_R.max_bars_per_word}::DOUBLE)
    OR ({_n(_Q.LINKS)} > 0 AND m.n <= {_n(_Q.LINKS)} * {_R.link_words})
    OR (m.n <= {_R.boilerplate_max_words} AND regexp_matches(m.x, '{_BOILERPLATE}'))
    OR (m.n >= 3 AND {_n('[0-9]')} > m.c * {_R.max_digit_share}::DOUBLE)
    OR (m.c > m.n * {_R.max_word_chars} AND NOT regexp_matches(m.x, '[^\\x00-\\x7F]')))"""
_ENTRY = f"m.n BETWEEN 1 AND {_R.menu_words} AND NOT regexp_matches(m.x, '{_Q.MARKS}')"

ORACLES = {
    "op2_quality_rules": rf"""
WITH base AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents
), lines AS (
    SELECT rid, regexp_matches(t, '{_Q.MARKS}') AS punctuated, list_transform(string_split(t, chr(10)), lambda x: {{x: x, n: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')),
        c: length(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ''))}}) AS lines FROM base
), marked AS (
    SELECT rid, lines, list_transform(list_filter(lines, lambda m: m.n > 0), lambda m: m.x) AS worded,
        list_transform(lines, lambda m: {_ENTRY}) AS menu, list_transform(lines, lambda m: {_LINE}) AS good FROM lines
), judged AS (
    SELECT rid, lines, worded, list_filter(lines, lambda m, i: good[i] AND NOT (menu[i] AND (
        (coalesce(menu[nullif(i - 1, 0)], false) AND (coalesce(CASE WHEN i > 2 THEN menu[i - 2] END, false) OR coalesce(menu[i + 1], false)))
        OR (coalesce(menu[i + 1], false) AND coalesce(menu[i + 2], false))))) AS lefts FROM marked
), windows AS (
    SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)
), again AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
    FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
), found AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(t, {_BLANKS}, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        (len(lines) - len(lefts))::BIGINT AS n_removed_lines,
        CASE WHEN length(translate(t, {_BLANKS}, '')) > 0 THEN
            1 - coalesce(list_sum(list_transform(lefts, lambda m: m.c)), 0)::DOUBLE / length(translate(t, {_BLANKS}, ''))
            ELSE 0.0 END::DOUBLE AS lost_share
    FROM base JOIN judged USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
    NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
        AND lost_share <= {_R.max_lost_share}::DOUBLE AS kept,
    n_removed_lines, lost_share
FROM found
""",
    "op8_mixing": rf"""
WITH d AS (
    SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
        ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
    FROM d GROUP BY source
), r AS (
    SELECT *, source_size * 2.0::DOUBLE AS most,
        (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
            - coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM s WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST)
), t AS (
    SELECT source, source_size, weight,
        CASE WHEN most <= weight * rest OR max(rest) FILTER (most > weight * rest) OVER () IS NULL THEN most
            ELSE weight * max(rest) FILTER (most > weight * rest) OVER () END AS target
    FROM r
), o AS (
    SELECT d.*, source_size, target, weight, row_number() OVER () AS rid,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
    SELECT rid, size, sum(size) OVER (ORDER BY (2 * (sent + epoch * source_size) - size)::DOUBLE / weight, h, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto
    FROM o, (VALUES (0), (1)) e(epoch) WHERE size > 0
), k AS (
    SELECT rid, count(*) AS copies FROM c WHERE 2.0::DOUBLE * upto - size <= 2.0::DOUBLE * (SELECT sum(size) * 1.5::DOUBLE FROM d) GROUP BY rid
)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM o LEFT JOIN k USING (rid)
""",
    "op9_exact_dedup": """
SELECT DISTINCT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
