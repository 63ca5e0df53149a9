"""URL filters: all glob rules at once, as a bit-parallel automaton.

Every rule becomes a row of states in one long bit vector, packed into 64-bit
words.  Reading a character shifts the vector by one, keeps the states whose
next symbol fits, and lets states under a star stay.  A batch of URLs is read
column by character column, so each step is a handful of numpy operations for
all URLs and all rules together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import lower_ascii

#: URLs stepped together; bounds the memory of the state matrix.
BLOCK_URLS = 4096


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and all its subdomains whose path starts with ``path``.

    In both parts ``*`` stands for any characters and ``?`` for one; in a host
    neither crosses into the path.  An empty path fits every path.
    """

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


#: What the method adds where no given rule fits.
DEFAULT_GLOBS = (
    Rule("block", "*cheap-pills*"),
    Rule("block", "*spam-farm*"),
    Rule("block", "*casino*"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Shift-And masks of glob patterns over ``.host`` + ``/`` + path.

    Rules come in order of preference: the first that fits wins, which is the
    lowest accepting bit.
    """

    def __init__(self, rules: Sequence[Rule]):
        starts, symbols, loops, ends = [], [], [], []
        for rule in rules:
            starts.append(len(symbols))
            symbols.append(None)  # the state before the first symbol
            loops.append("host")  # any subdomain in front
            for part, text in (("host", "." + rule.host), ("path", "/" + rule.path)):
                for char in text.encode():
                    if char == ord("*"):
                        loops[-1] = part
                    else:
                        symbols.append("any" if char == ord("?") and part == "path" else "host" if char == ord("?") else char)
                        loops.append(None)
            loops[-1] = "path"  # whatever follows the prefix
            ends.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.fits = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept = np.zeros(self.words, np.uint64)
        self.rule_of = np.full(self.words * 64 + 1, -1, np.int32)
        every = np.arange(256)
        in_host = every != ord("/")
        for bit, (symbol, loop) in enumerate(zip(symbols, loops)):
            word, mask = bit // 64, np.uint64(1) << np.uint64(bit % 64)
            if symbol is not None:
                chars = every if symbol == "any" else every[in_host] if symbol == "host" else [symbol]
                self.fits[chars, word] |= mask
            if loop:
                self.stays[every if loop == "path" else every[in_host], word] |= mask
        for rule, (first, last) in enumerate(zip(starts, ends)):
            self.start[first // 64] |= np.uint64(1) << np.uint64(first % 64)
            self.accept[last // 64] |= np.uint64(1) << np.uint64(last % 64)
            self.rule_of[last] = rule

    def first_match(self, subjects: Sequence[bytes]) -> np.ndarray:
        """Index of the first fitting rule of each subject, -1 for none."""
        out = np.full(len(subjects), -1, np.int32)
        by_length = sorted(range(len(subjects)), key=lambda i: len(subjects[i]))
        for block in range(0, len(by_length), BLOCK_URLS):
            chosen = by_length[block : block + BLOCK_URLS]
            out[chosen] = self._block([subjects[i] for i in chosen])
        return out

    def _block(self, subjects: list[bytes]) -> np.ndarray:
        one, top = np.uint64(1), np.uint64(63)
        lengths = np.array([len(s) for s in subjects])
        data = np.frombuffer(b"".join(subjects) + b"\0", np.uint8)
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        states = np.repeat(self.start[None, :], len(subjects), axis=0)
        alive = 0  # subjects before this one, sorted by length, have ended
        for at in range(int(lengths[-1]) if len(lengths) else 0):
            while lengths[alive] <= at:
                alive += 1
            now = states[alive:]
            char = data[offsets[alive:] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[alive:] = (moved & self.fits[char]) | (now & self.stays[char])
        return self._lowest(states & self.accept)

    def _lowest(self, accepted: np.ndarray) -> np.ndarray:
        hit = accepted != 0
        word = hit.argmax(axis=1)
        value = accepted[np.arange(len(accepted)), word]
        lowest = value & (~value + np.uint64(1))
        bit = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)  # trailing zeros
        return np.where(hit.any(axis=1), self.rule_of[np.minimum(word * 64 + bit, self.words * 64)], -1)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    globs: Sequence[Rule] = DEFAULT_GLOBS,
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Judge every URL; columns: the key, host, path, rule, verdict.

    The longest of ``rules`` that fits wins (equal lengths: the earlier one)
    and is named in ``rule``.  Where none fits, ``rule`` is null and the longest
    fitting glob of ``globs`` decides, else ``default``.  A null URL or one
    without ``://`` has an empty host and path, so only ``default`` or a glob
    that fits anything applies.  Repeated rows and null keys give a row each;
    very long URLs are read whole.  One pass, no shuffle; the masks are part of
    the program.
    """
    given = sorted(rules, key=lambda r: -len(r.name))
    added = sorted(globs, key=lambda r: -len(r.name))
    machine = GlobAutomaton([*given, *added])

    @F.pandas_udf("int")
    def first_match(subject: pd.Series) -> pd.Series:
        return pd.Series(machine.first_match([s.encode() for s in subject]))

    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    subject = F.concat(F.lit("."), "host", F.lit("/"), "path")
    found = parts.withColumn("__rule", first_match(subject))
    names = F.array(*[F.lit(r.name) for r in given], *[F.lit(None).cast("string") for _ in added])
    verdicts = F.array(*[F.lit(r.verdict) for r in [*given, *added]])
    at = F.when(F.col("__rule") >= 0, F.col("__rule"))
    return found.select(
        key, "host", "path", F.get(names, at).alias("rule"), F.coalesce(F.get(verdicts, at), F.lit(default)).alias("verdict")
    )
