"""Quality rules: line-first cleaning with DataFrame expressions only.

Each line is judged by rules of punctuation, navigation and boilerplate (see
:func:`line_passes`, and menus: three or more short lines without a sentence
mark in a row); failing lines are removed; a document that loses too much of its
text is rejected. Everything happens inside one row, so the plan has no shuffle.

Edge cases: a null text counts as empty. Empty and blank texts have no words,
fail the base rules and are rejected; their cleaned text is "". Long texts are
judged whole, in time linear in their length but for one sort of those with
repeated windows. Repeated rows are judged alike, one result each. An empty
table gives an empty result. Other columns pass through :func:`clean_documents`
untouched: the input row travels as one struct, so none of its names can clash
with the working columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import BLANKS

SYMBOLS = r"[#*$%&|<>]"
#: Signs that prose hardly uses; bars and other separators are judged as navigation.
ODD = r"[#*$%&<>]"
SEPARATORS = "[|»›•·]"
#: Marks that end or divide sentences.
MARKS = "[.!?…:;。！？؟।]"
SMALL, CAPITALS = "[a-zà-öø-ÿ]", "([A-ZÀ-ÖØ-Þ]{2,}[^A-ZÀ-ÖØ-Þ]+){3}"
LINKS = r"https?://|www\."
#: Phrases of web furniture in the corpus's four languages; a line with one of them and few words is boilerplate.
PHRASES = (
    "enable javascript", "javascript is (disabled|required)", "accept (all )?cookies", "(we|site|website) uses? cookies", "cookie policy", "privacy policy", "terms of (use|service)",
    "subscribe to our", "sign up for our", "log ?in to (view|continue)", "click here to", "skip to (main )?content", "back to top", "share (this )?on (facebook|twitter|x)", "read more", "lorem ipsum",
    "bitte aktivieren sie javascript", "(alle )?cookies akzeptieren", "(diese )?(seite|website) verwendet cookies", "datenschutzerkl.rung", "allgemeine gesch.ftsbedingungen", "newsletter abonnieren",
    "zum inhalt springen", "nach oben", "weiterlesen", "hier klicken", "auf facebook teilen",
    "veuillez activer javascript", "accepter (tous )?les cookies", "ce site utilise des cookies", "politique de confidentialit.", "conditions d.utilisation", "mentions l.gales",
    "abonnez-vous .", "aller au contenu", "haut de page", "lire la suite", "cliquez ici", "partager sur facebook",
    "active javascript", "aceptar (todas )?las cookies", "este sitio (web )?utiliza cookies", "pol.tica de privacidad", "t.rminos de uso", "aviso legal", "suscr.bete a", "saltar al contenido",
    "volver arriba", "leer m.s", "haz clic aqu.", "compartir en facebook",
)
BOILERPLATE = f"(?i)(^|[{BLANKS}(\"'|>-])({'|'.join(PHRASES)})"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are per word of the line."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbols_per_word: float = 0.1
    max_shouts_per_word: float = 0.3
    unmarked_words: int = 12
    capital_words: int = 8
    max_bars_per_word: float = 0.1
    menu_words: int = 3
    link_words: int = 4
    boilerplate_max_words: int = 25
    max_digit_share: float = 0.5
    max_word_chars: int = 60
    max_lost_share: float = 0.3


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _measured(line: Column) -> Column:
    """Struct of a line x, its number of words n and of their characters c."""
    words = F.split(line, f"[{BLANKS}]+")
    return F.struct(line.alias("x"), F.size(F.array_remove(words, "")).alias("n"), F.length(F.array_join(words, "")).alias("c"))


def in_menu(line: Column, rules: LineRules) -> Column:
    """Whether a measured line may be an entry of a menu: a few words and no mark."""
    return (line["n"] > 0) & (line["n"] <= rules.menu_words) & ~F.rlike(line["x"], F.lit(MARKS))


def line_passes(line: Column, rules: LineRules, punctuated: Column | None = None) -> Column:
    """True for measured lines to keep by their own looks; blank lines pass.

    Punctuation: not too many odd signs or double exclamation marks, a sentence
    mark somewhere if the line is long and its text has any, and not all in capitals. Navigation: not
    cut up by separators, and not mostly links. Boilerplate: no phrase of web
    furniture. Besides, a line is no table of numbers and no encoded data.
    """
    x, n, chars = line["x"], line["n"], line["c"]
    shouts = (F.length(x) - F.length(F.replace(x, F.lit("!!"), F.lit("")))) / 2
    bars, links = _count(x, SEPARATORS), _count(x, LINKS)
    unusual = F.rlike(x, F.lit(f"[0-9{ODD[1:-1]}{SEPARATORS[1:-1]}]"))  # most lines have none, so nothing is counted
    linked = F.contains(x, F.lit("://")) | F.contains(x, F.lit("www."))
    fails = (
        (unusual & ((_count(x, ODD) > n * rules.max_symbols_per_word + 2) | ((bars >= 2) & (bars > n * rules.max_bars_per_word)) | ((n >= 3) & (_count(x, "[0-9]") > chars * rules.max_digit_share))))
        | (shouts > n * rules.max_shouts_per_word + 1)
        | ((n >= rules.unmarked_words) & (F.lit(True) if punctuated is None else punctuated) & ~F.rlike(x, F.lit(MARKS)))
        | ((n >= rules.capital_words) & ~F.rlike(x, F.lit(SMALL)) & F.rlike(x, F.lit(CAPITALS)))
        | (linked & (links > 0) & (n <= links * rules.link_words))
        | ((n <= rules.boilerplate_max_words) & F.rlike(x, F.lit(BOILERPLATE)))
        | ((chars > n * rules.max_word_chars) & ~F.rlike(x, F.lit(r"[^\x00-\x7F]")))
    )
    return (n == 0) | ~fails


def _repeat_words(df: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``repeat``: words inside 8-word windows whose content occurs again in the text.

    Windows are compared by a 64-bit hash within one text: words' hashes are
    joined in pairs, then fours, then eights. Each step is a projection of its
    own that reads the array before it twice, so that Catalyst does not inline
    one array expression into the lambda of the next.
    """
    rest = lambda s, k=1: F.slice(s, F.lit(k + 1), F.greatest(F.size(s) - k, F.lit(0)))
    n = F.size("h")
    df = df.select(*carried, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    df = df.select(*carried, F.when(n >= 8, F.col("h")).otherwise(F.array().cast("array<bigint>")).alias("w"))
    for k in (1, 2, 4):
        df = df.select(*carried, F.slice(F.zip_with("w", rest(F.col("w"), k), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("w") - k, F.lit(0))).alias("w"))
    df = df.select(*carried, F.when(F.size(F.array_distinct("w")) < F.size("w"), F.col("w")).alias("w"))
    # From here on texts without a repeated window carry null and cost nothing.
    df = df.select(*carried, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("s"))
    same = F.zip_with("s", rest(F.col("s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    df = df.select(*carried, "s", same.alias("e"))
    marked = F.zip_with("s", "e", lambda a, x: F.struct(a["i"].alias("i"), x.alias("x")))
    starts = F.zip_with(marked, F.concat(F.array(F.lit(False)), "e"), lambda a, before: F.when(a["x"] | before, a["i"]))
    df = df.select(*carried, F.sort_array(F.filter(starts, lambda x: x.isNotNull())).alias("p"))
    p = F.col("p")
    gaps = F.zip_with(p, rest(p), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
    return df.select(*carried, F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long").alias("repeat"))


def judge(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: struct ``row`` (all input columns) and the findings.

    Findings: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_lines, lost_share, base_failed, kept, cleaned_text.
    """
    t = F.coalesce(F.col("row")[text], F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.select("row", t.alias("t"))
    rows = rows.select(
        "row", F.array_remove(F.split("t", f"[{BLANKS}]+"), "").alias("words"), F.transform(F.split("t", "\n"), _measured).alias("lines"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"), F.rlike("t", F.lit(MARKS)).alias("punctuated"),
    )
    rows = rows.select("row", "words", "lines", "n_symbols", "punctuated", F.transform("lines", lambda x: in_menu(x, rules)).alias("menu"))
    entry = lambda i: F.coalesce(F.get("menu", i), F.lit(False))  # noqa: E731  three entries in a row make a menu
    menu = lambda i: entry(i) & ((entry(i - 1) & (entry(i - 2) | entry(i + 1))) | (entry(i + 1) & entry(i + 2)))
    worded = F.filter("lines", lambda x: x["n"] > 0)
    rows = rows.select(
        "row", "words", "lines", "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        worded["x"].alias("worded"), F.filter("lines", lambda x, i: ~menu(i) & line_passes(x, rules, F.col("punctuated"))).alias("left"),
    )
    rows = rows.select(
        "row", "words", "word_chars", "n_symbols", "n_words", F.array_join(F.col("left")["x"], "\n").alias("cleaned_text"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed_lines"),
        F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("left_chars"),
    )
    carried = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_removed_lines", "left_chars", "cleaned_text"]
    rows = _repeat_words(rows, carried)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("repeat") > rules.max_repeat_percent * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("left_chars") / F.col("word_chars")).otherwise(0.0)
    return rows.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("repeat").alias("n_repeat_words"),
        "n_removed_lines", lost.alias("lost_share"), failed.alias("base_failed"),
        (~failed & (lost <= rules.max_lost_share)).alias("kept"), "cleaned_text",
    )


def clean_documents(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed; all input columns, nothing else.

    A column named ``n_chars``, where there is one, follows the cleaned text.
    """
    # The partition number keeps Catalyst from pushing the filter below the steps of ``judge``,
    # which would write all of them out again as one nested expression.
    found = judge(df, text, rules).withColumn("p", F.spark_partition_id()).where(F.col("kept") & (F.col("p") >= 0))
    cols = []
    for c in df.columns:
        new = {text: F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast(df.schema[c].dataType)}.get(c)
        cols.append((new if new is not None else F.col("row")[c]).alias(c))
    return found.select(*cols)
