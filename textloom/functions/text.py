"""String columns: cleaning, chunking, sentence rules, prompts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from textloom.functions.patterns import CLOSED_SENTENCE, SPACE


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.str.normalize("NFC")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return text.str.normalize("NFKC")


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def split_whitespace(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def normalize_text(text: Column) -> Column:
    """NFC, then one space for each run of white space."""
    return collapse_whitespace(nfc(text))


def clean_unicode(text: Column) -> Column:
    """NFKC; printable ASCII and U+00A0..U+D7FE kept; zero-width marks gone."""
    kept = F.regexp_replace(nfkc(text), r"[^\t-\r\x20-\x7E\x{A0}-\x{D7FE}]", "")
    return strip(F.regexp_replace(kept, r"[\x{200B}-\x{200D}\x{FEFF}]", ""))


# Bracketed placeholders and the markup that is taken out.
PLACEHOLDER = r"\[[A-Z][A-Za-z0-9'’\-,\. ]{1,50}\]"
MARKUP = r"(\*\*|__|[*_`#>\[\]\(\)\~\-]{2,}|!\[[^\]]*\]\([^\)]*\)|<[A-Za-z\/][^>]*>)"


def strip_markup_artifacts(text: Column) -> Column:
    flat = F.regexp_replace(text, r"\n", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, PLACEHOLDER, ""), MARKUP, "")
    return strip(F.regexp_replace(flat, rf"[{SPACE}]{{2,}}", " "))


def truncate_to_sentence(text: Column) -> Column:
    """Everything up to the last sentence ender; unchanged without one."""
    cut = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    return F.when(cut == "", text).otherwise(cut)


def strip_reasoning(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def closed_sentences(text: Column) -> Column:
    """Sentences with their ender; an open tail is lost.  The tail is cut off
    before the sentences are matched, so a long text without an ender costs
    one pass."""
    closed = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    return F.regexp_extract_all(closed, F.lit(f"({CLOSED_SENTENCE})"), 1)


def group_sentences(sentences: Column, per_chunk: int = 4) -> Column:
    """Chunks of ``per_chunk`` sentences joined by a space.  ``sentences`` must
    be a column of the table: inside the lambda an expression would be
    evaluated once per chunk."""
    groups = F.ceil(F.size(sentences) / per_chunk).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(groups - 1, F.lit(0))), lambda i: i < groups)
    return F.transform(
        starts, lambda i: F.array_join(F.slice(sentences, i * per_chunk + 1, per_chunk), " ")
    )


def _pieces(text: Column) -> Column:
    marked = F.regexp_replace(text, rf"([.!?]+)[{SPACE}]+", "$1\u0001")
    return F.split(marked, "\u0001")


def split_sentences(text: Column) -> Column:
    """Fixed rule: a sentence ends after a run of ``.!?`` that white space or
    the end of the text follows."""
    return F.filter(F.transform(_pieces(text), strip), lambda s: s != "")


def sentence_sizes(text: Column, size: Callable[[Column], Column]) -> Column:
    """``size`` of each sentence of ``split_sentences``, for sizes that white space at its ends does not change."""
    return F.transform(F.filter(_pieces(text), lambda s: s.rlike(f"[^{SPACE}]")), size)


def join_chunks(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, strip), " ")


def content_seed(*parts: Column) -> Column:
    """sha256 of the joined parts modulo 2**32, i.e. its last 8 hex digits."""
    return F.conv(F.right(F.sha2(F.concat(*parts), 256), F.lit(8)), 16, 10).cast("bigint")


def fill_prompt(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace every ``[KEY]`` by the row's own value."""
    for key, value in values.items():
        template = F.replace(template, F.lit(f"[{key.upper()}]"), value.cast("string"))
    return template


def context_block(before: Column, after: Column, n_words: int = 2000) -> Column:
    """Last ``n_words`` before and first ``n_words`` after a gap, as a prompt."""
    left, right = split_whitespace(before), split_whitespace(after)
    first = F.greatest(F.size(left) - n_words + 1, F.lit(1))
    return F.concat(
        F.lit("### START: "),
        F.array_join(F.slice(left, first, n_words), " "),
        F.lit("\n\n### END: "),
        F.array_join(F.slice(right, 1, n_words), " "),
    )
