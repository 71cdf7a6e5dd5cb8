"""Text functions as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins for hyphen breaks and paragraph breaks; texts holding them are altered.
HYPHEN_BREAK, PAGE_BREAK = "HYPHENBREAK", "DOUBLEPAGEBREAK"


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end (``trim`` takes only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Join hyphenated and broken lines, keep paragraph breaks, single spaces."""
    c = F.replace(c, F.lit("-\n"), F.lit(HYPHEN_BREAK))
    c = F.regexp_replace(c, r"\n\n+", PAGE_BREAK)
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    c = F.replace(F.replace(c, F.lit(HYPHEN_BREAK), F.lit("")), F.lit(PAGE_BREAK), F.lit("\n\n"))
    return strip(F.regexp_replace(c, " +", " "))


def is_title(c: Column) -> Column:
    """All upper case, at least five letters A-Z, at least two of them vowels; counted over the whole string."""
    letters = F.regexp_replace(c, "[^A-Z]", "")
    vowels = F.regexp_replace(letters, "[^AEIOU]", "")
    return (c == F.upper(c)) & (F.length(letters) >= 5) & (F.length(vowels) >= 2)


def fence_strip(c: Column) -> Column:
    """Without backticks at the ends, and without the first "tsv" anywhere."""
    c = F.btrim(c, F.lit("`"))
    at = F.instr(c, "tsv")
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 3, F.length(c)))).otherwise(c)


def char_count(c: Column) -> Column:
    return F.length(c).cast("long")


def word_count(c: Column) -> Column:
    """Runs of non-blank characters."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+"))).cast("long")


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def paragraph_count(c: Column) -> Column:
    return count_of(c, "\n\n") + 1


def line_count(c: Column) -> Column:
    return count_of(c, "\n") + 1


def filled_count(c: Column, delimiter: str) -> Column:
    """Parts between delimiters that are not blank."""
    return F.size(F.filter(F.split(c, delimiter), lambda p: strip(p) != "")).cast("long")


def title_case(c: Column) -> Column:
    """Upper case after any non-letter, lower case elsewhere (``initcap`` looks only at blanks)."""
    chars = F.split(F.lower(c), "")
    first = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(True).alias("start")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.when(acc["start"], F.upper(x)).otherwise(x)).alias("out"), ~F.rlike(x, F.lit(r"\p{L}")).alias("start")
        ),
    )
    return first["out"]


def truncate_tokens(c: Column, n: int) -> Column:
    """The first n blank-separated tokens; a stand-in for a model's tokenizer."""
    return F.array_join(F.slice(F.split(strip(c), r"\s+"), 1, n), " ")


def reading_ease(c: Column) -> Column:
    """Flesch reading ease, 206.835 - 1.015 words/sentences - 84.6 syllables/words.

    Syllables are vowel groups (y included), one per word at least; sentences are
    runs of text ended by . ! or ?. Dictionary syllables would differ a little.
    """
    return F.arrow_udf(_ease, "double").asNondeterministic()(c)  # or a filter on it runs it twice


def _ease(texts: pa.Array) -> pa.Array:
    count = lambda a, pattern: pc.count_substring_regex(a, pattern).cast(pa.float64()).to_numpy(zero_copy_only=False)
    low = pc.utf8_lower(texts)
    n, groups, voiced = (count(low, p) for p in ("[a-z]+", "[aeiouy]+", "[a-z]*[aeiouy][a-z]*"))
    sentences = np.maximum(1, count(texts, "[A-Za-z][^.!?]*"))
    some = np.nan_to_num(n) > 0
    n = np.where(some, n, 1)
    ease = 206.835 - 1.015 * (n / sentences) - 84.6 * ((groups + n - voiced) / n)
    return pa.array(ease, mask=~some)


def character_error_rate(truth: Column, found: Column) -> Column:
    """Edit distance over the length of the truth; null for an empty truth, may exceed 1."""
    return F.when(F.length(truth) > 0, F.levenshtein(truth, found) / F.length(truth))
