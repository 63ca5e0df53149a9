"""Quality rules as a ledger: measure once, decide as often as needed.

One pass evaluates every rule on every whole text and stores the measurements
and one bit per failed rule.  A policy is a set of rules, so applying one, or
asking what each rule alone costs, only looks at bits.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import map_texts

MEASURES = (
    "n_words",  # runs of anything but the six white-space characters
    "word_chars",  # code points in words
    "n_symbols",  # characters of [#*$%&|<>]
    "n_lines",  # lines with a word
    "n_dup_lines",  # of these, equal to an earlier line
    "n_repeat_words",  # in windows of eight words found twice or more
    "n_upper",  # characters A-Z
)

#: Rule -> condition on the measurements that means failure, in bit order.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 40 * word_chars",
}

#: Policy and version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}

WINDOW = 8
_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def mask(policy: tuple[str, ...]) -> int:
    """The bits of the rules of a policy."""
    return sum(1 << list(RULES).index(rule) for rule in policy)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Word numbers are combined pairwise, so that after three steps every window
    of eight has a number of its own: equal numbers mean equal windows.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    mixed = np.zeros(n, np.uint64)  # equal windows agree; most texts end here
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n] + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    codes, width = ids.astype(np.int64), 1
    while width * 2 <= window:
        codes = codes[:-width] * np.int64(len(words) + 1) + codes[width:]
        codes = np.unique(codes, return_inverse=True)[1]
        width *= 2
    for i in range(width, window):  # windows that are no power of two
        codes = codes[:-1] * np.int64(len(words) + 1) + ids[i : i + len(codes) - 1].astype(np.int64)
        codes = np.unique(codes, return_inverse=True)[1]
    twice = np.bincount(codes)[codes] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """All measurements of one text, in the order of MEASURES."""
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    code_points = len(raw) - int(counts[0x80:0xC0].sum())
    lines = [line for line in raw.split(b"\n") if line.split()]
    return (
        len(words),
        code_points - int(counts[_SPACES].sum()),
        int(counts[_SYMBOLS].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(counts[65:91].sum()),
    )


def failure_bits() -> Column:
    """One bit for each failed rule, from the stored measurements."""
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, the measurements and fail_bits of every whole text.

    A null text counts as one without words: all measurements are 0, and the
    rule of few words fails.  Every row gives one row, repeated rows and null
    keys too; other columns are not read.  One pass, no shuffle.
    """

    def compute(texts: list[bytes | None]) -> dict:
        rows = [measure(t or b"") for t in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(MEASURES)}

    added = ", ".join(f"{name} long" for name in MEASURES)
    return map_texts(docs, text, [key], added, compute).withColumn("fail_bits", failure_bits())


def passes(policy: tuple[str, ...]) -> Column:
    """Whether a ledger row fails none of the rules of a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and rule: rows, kept, failed, failed by this rule alone,
    and kept if the rule were left out.

    Rows are first counted by bit pattern (at most two to the number of rules),
    so the ledger is read once and little is shuffled.  An empty ledger gives no rows.
    """
    cases = [(p, r, mask(rules), mask((r,))) for p, rules in policies.items() for r in rules]
    listed = ", ".join(f"('{p}', '{r}', {m}L, {b}L)" for p, r, m, b in cases)
    table = entries.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(policy, rule, mask, bit)")
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    # Both sides are bounded by the number of rules, not by the corpus.
    return (
        patterns.crossJoin(F.broadcast(table))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_rows"),
            rows_where(failed == 0).alias("kept"),
            rows_where(failed.bitwiseAND(F.col("bit")) != 0).alias("failed"),
            rows_where(failed == F.col("bit")).alias("failed_alone"),
            rows_where(failed.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
        )
    )
