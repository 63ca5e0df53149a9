"""The twelve text statistics as column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.patterns import (
    ASCII_PUNCT,
    DIGIT,
    SENTENCE_RUN,
    SPACE,
    UPPER,
    URL,
    WORD,
)
from textloom.functions.text import split_whitespace

METRICS = [
    "n_chars",
    "n_chars_nospace",
    "n_words",
    "avg_word_len",
    "n_sents",
    "n_punct",
    "punct_ratio",
    "upper_ratio",
    "digit_ratio",
    "url_count",
    "type_token_ratio",
    "hapax_ratio",
]


#: A run of equal words in a sorted list, a space before, between and behind them; possessive, so that
#: neither a long word nor a long run is tried twice.
REPEATED = r"(?<= )([^ ]++) (?:\1 )++"


def words(text: Column) -> Column:
    """White-space pieces without outer punctuation that hold a letter or number.

    One replacement turns every separator, with the punctuation around it,
    into a space; only pieces that start with ``_`` need a second look.
    """
    spaced = F.regexp_replace(
        text,
        rf"^[^{WORD}]+|[^{WORD}{SPACE}]*[{SPACE}]+[^{WORD}]*|[^{WORD}]+\z",
        " ",
    )
    return F.filter(
        F.split(spaced, " "),
        lambda w: (w != "") & (~w.startswith("_") | w.rlike(r"[\p{L}\p{N}]")),
    )


def words_ascii(text: Column) -> Column:
    """As ``words`` with ASCII punctuation stripped and an ASCII letter or digit required."""
    bare = F.transform(
        split_whitespace(text),
        lambda w: F.regexp_replace(w, rf"^[{ASCII_PUNCT}]+|[{ASCII_PUNCT}]+\z", ""),
    )
    return F.filter(bare, lambda w: w.rlike("[A-Za-z0-9]"))


def _left_over(text: Column, pattern: str) -> Column:
    """Characters that remain after taking ``pattern`` out; far cheaper than
    collecting single-character matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("bigint")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def with_text_metrics(df: DataFrame, text: str = "text", ascii_rules: bool = False) -> DataFrame:
    """Add the twelve statistics.

    ``ascii_rules`` selects the stricter variant: ASCII punctuation and words,
    ``_`` counted as punctuation, single sentence enders, blank text has no
    sentence.  Sorting the lower-cased words once makes type and once-only
    counts a linear pass.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    no_punct = rf"[\p{{L}}\p{{N}}{SPACE}]+" if ascii_rules else rf"[{WORD}{SPACE}]+"
    # Letters and plain ASCII hold no digit, plain ASCII but A-Z no capital: a cheap class first, the long one on the rest.
    maybe_upper = F.regexp_replace(body, r"[\x00-@\[-\x{BF}]+", "")
    maybe_digit = F.regexp_replace(body, r"[\x00-/:-\x{B1}\p{L}]+", "")
    tokens = words_ascii(body) if ascii_rules else words(body)
    runs = _matches(body, SENTENCE_RUN)
    empty = (
        ~body.rlike(rf"[^{SPACE}]") if ascii_rules else body == F.lit("")
    )
    staged = df.withColumn("__tokens", tokens).withColumn(
        "__sorted",
        F.array_remove(F.sort_array(F.split(F.lower(F.array_join("__tokens", " ")), " ")), ""),
    )
    staged = staged.withColumns(
        {
            "__types": F.size(F.array_distinct("__sorted")).cast("bigint"),
            "__repeated": _matches(
                F.concat(F.lit(" "), F.array_join("__sorted", " "), F.lit(" ")), REPEATED
            ),
            "n_chars": F.length(body).cast("bigint"),
            "n_chars_nospace": _left_over(body, rf"[{SPACE}]+"),
            "n_words": F.size("__tokens").cast("bigint"),
            "__word_chars": F.length(F.array_join("__tokens", "")).cast("bigint"),
            "n_sents": F.when(empty, F.lit(0)).otherwise(F.greatest(runs, F.lit(1))).cast("bigint"),
            "n_punct": _left_over(body, no_punct),
            "__upper": _left_over(maybe_upper, f"[^{UPPER}]+"),
            "__digit": _left_over(maybe_digit, f"[^{DIGIT}]+"),
            "url_count": _matches(body, URL),
        }
    )
    n_words, solid = F.col("n_words"), F.col("n_chars_nospace")
    ratios = {
        "avg_word_len": _ratio(F.col("__word_chars"), n_words),
        "punct_ratio": _ratio(F.col("n_punct"), solid),
        "upper_ratio": _ratio(F.col("__upper"), solid),
        "digit_ratio": _ratio(F.col("__digit"), solid),
        "type_token_ratio": _ratio(F.col("__types"), n_words),
        "hapax_ratio": _ratio(F.col("__types") - F.col("__repeated"), n_words),
    }
    added = {**{m: F.col(m) for m in METRICS if m not in ratios}, **ratios}
    return staged.select(*df.drop(*METRICS).columns, *[added[m].alias(m) for m in METRICS])
