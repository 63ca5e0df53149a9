"""Sentence boundaries learned from the corpus, without a list of abbreviations.

A period ends a sentence, an abbreviation, or both.  Counts over the whole corpus
tell them apart (Kiss and Strunk, Unsupervised Multilingual Sentence Boundary
Detection, 2006):

* an abbreviation is a word that hardly occurs without a period, by a likelihood
  ratio scaled by its length, its inner periods and its occurrences without one;
* a frequent sentence starter follows sentence ends more often than by chance;
* initials and numbers with a period that belong to the next word are collocations;
* the case of a word inside and at the beginning of sentences tells whether a
  capital letter means anything.

Texts are read to count distinct tokens and distinct pairs around possible ends;
everything else works on these tables.  What is decided for a pair is looked up
for the places where it stands, and only places that are no end are kept for a
text.  Nothing that grows with the vocabulary is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.patterns import SPACE
from textloom.functions.text import strip
from textloom.operators.ranking import salted_lookup
from textloom.session import materialize

#: Quotes and brackets, as bodies of character classes that Java and RE2 read alike.
CLOSERS = r"\x22\x27)\]}\x{BB}\x{201D}\x{2019}"
OPENERS = r"\x22\x27(\[{\x{AB}\x{201C}\x{2018}\x{BF}\x{A1}"
#: A possible end: enders with what closes after them, in front of white space.
POSSIBLE_END = rf"([.!?]+[{CLOSERS}]*)([{SPACE}])"
ENDS = rf"[.!?][{CLOSERS}]*$"
#: Marks a possible end while a text is cut.
MARK = "\u0001"

#: Thresholds of the paper: abbreviations, collocations, sentence starters; share of periods behind an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, PERIOD_SHARE = 0.3, 7.88, 30.0, 0.99


def pieces(text: Column) -> Column:
    """The text cut behind every possible end; joined they are the text."""
    return F.split(F.regexp_replace(text, POSSIBLE_END, f"$1{MARK}$2"), MARK)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{SPACE}]+"), "")


def token_type(token: Column) -> Column:
    """Lower case, without what opens, closes or ends."""
    bare = F.regexp_replace(F.regexp_replace(token, rf"^[{OPENERS}]+", ""), rf"[.!?,;:{CLOSERS}]+$", "")
    return F.lower(bare)


def token_form(token: Column) -> Column:
    """'dots', 'dot', 'end' (other enders) or 'none': how a token ends."""
    return (
        F.when(token.rlike(rf"\.\.[{CLOSERS}]*$"), "dots")
        .when(token.rlike(rf"\.[{CLOSERS}]*$"), "dot")
        .when(token.rlike(ENDS), "end")
        .otherwise("none")
    )


def token_case(token: Column) -> Column:
    """'upper', 'lower' or 'none', by the first character behind what opens."""
    opened = rf"^[{OPENERS}]*"
    return F.when(token.rlike(opened + r"\p{Lu}"), "upper").when(token.rlike(opened + r"\p{Ll}"), "lower").otherwise("none")


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, begins, c): distinct tokens, apart at the beginning of a text or behind an ender."""
    listed = docs.select(tokens(F.col(text)).alias("__t"))
    # Each token beside the one before it; the first stands behind an ender.
    before = F.concat(F.array(F.lit(".")), F.slice("__t", F.lit(1), F.greatest(F.size("__t") - 1, F.lit(0))))
    before = F.slice(before, F.lit(1), F.size("__t"))
    rows = listed.select(F.inline(F.arrays_zip(F.col("__t").alias("token"), before.alias("before"))))
    return rows.groupBy("token", F.col("before").rlike(ENDS).alias("begins")).agg(F.count("*").alias("c"))


def possible_ends(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, last, first): the tokens before and behind every possible end; piece ``at`` ends there.

    The end of a text is none.  Pieces without a token have no row.
    """
    cut = docs.select(key, F.transform(pieces(F.col(text)), tokens).alias("__p"))
    behind = F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0)))
    before = F.slice("__p", F.lit(1), F.greatest(F.size("__p") - 1, F.lit(0)))
    rows = F.zip_with(before, behind, lambda x, y: F.struct(F.element_at(F.when(F.size(x) > 0, x), -1).alias("last"), F.get(y, 0).alias("first")))
    found = cut.select(key, F.posexplode(rows).alias("at", "pair")).select(key, "at", "pair.last", "pair.first")
    return found.where("last IS NOT NULL AND first IS NOT NULL")


def type_counts(counted: DataFrame) -> DataFrame:
    """(type, n, dotted, lower, upper_inside, upper): occurrences of word types, from ``token_counts``."""
    c, case = F.col("c"), token_case(F.col("token"))
    typed = counted.select(
        token_type(F.col("token")).alias("type"), (token_form(F.col("token")) == "dot").alias("dot"), case.alias("case"), "begins", "c"
    )
    return typed.groupBy("type").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("dot"), c).otherwise(0)).alias("dotted"),
        F.sum(F.when(F.col("case") == "lower", c).otherwise(0)).alias("lower"),
        F.sum(F.when((F.col("case") == "upper") & ~F.col("begins"), c).otherwise(0)).alias("upper_inside"),
        F.sum(F.when(F.col("case") == "upper", c).otherwise(0)).alias("upper"),
    )


def _times_ln(x: Column, p: Column) -> Column:
    """x ln p, 0 for x = 0."""
    return F.when(x > 0, x * F.ln(p)).otherwise(0.0)


def likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio of "the second depends on the first" to "it does not".

    ``both``: occurrences of the two together, ``first`` and ``second``: of each, ``total``: of all.
    """
    apart, rest = second - both, F.greatest(total - first - second + both, F.lit(0))
    p, p1, p2 = second / total, both / first, apart / (total - first)

    def binomial(k: Column, n_less_k: Column, share: Column) -> Column:
        return _times_ln(k, share) + _times_ln(n_less_k, 1 - share)

    dependent = binomial(both, first - both, p1) + binomial(apart, rest, p2)
    return 2.0 * (dependent - binomial(both, first - both, p) - binomial(apart, rest, p))


def abbreviation_scores(types: DataFrame, total: int, dotted: int) -> DataFrame:
    """Types that occur with a period, with ``score``: at least ``ABBREVIATION`` makes an abbreviation.

    ``total`` and ``dotted`` are all tokens and those with a period.
    """
    share = (dotted + 0.5) / (total + 1.0)
    plain = (F.col("n") - F.col("dotted")).cast("double")
    ratio = 2.0 * (
        F.col("dotted") * (F.ln(F.lit(PERIOD_SHARE)) - F.ln(F.lit(share)))
        + plain * (F.ln(F.lit(1.0 - PERIOD_SHARE)) - F.ln(F.lit(1.0 - share)))
    )
    bare = F.length(F.replace("type", F.lit(".")))
    periods = F.length("type") - bare
    scale = F.exp(-bare.cast("double")) * (periods + 1) * F.pow(bare.cast("double"), -plain)
    some = types.where((F.col("dotted") > 0) & F.col("type").rlike(r"\p{L}"))
    return some.withColumn("score", ratio * scale)


@dataclass(frozen=True)
class SentenceModel:
    """Tables written once: word types, words before periods with their scores, sentence starters, collocations."""

    types: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def described_pairs(docs: DataFrame, scores: DataFrame, key: str, text: str) -> DataFrame:
    """(last, first, c) around the possible ends of the texts, with what the decision asks of the two tokens."""
    return _described(possible_ends(docs, key, text), scores)


def _described(places: DataFrame, scores: DataFrame) -> DataFrame:
    pairs = places.groupBy("last", "first").agg(F.count("*").alias("c"))
    pairs = pairs.select(
        "last",
        "first",
        "c",
        token_type(F.col("last")).alias("t1"),
        token_type(F.col("first")).alias("t2"),
        token_form(F.col("last")).alias("form"),
        token_case(F.col("first")).alias("case"),
    )
    # A single letter, or digits, before the period.
    pairs = pairs.withColumns({"single": F.col("t1").rlike(r"^\p{L}$"), "number": F.col("t1").rlike(r"^\p{Nd}+$")})
    known = scores.where(F.col("score") >= ABBREVIATION).select(F.col("type").alias("t1"), F.lit(True).alias("short"))
    pairs = pairs.join(known, "t1", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    return materialize(pairs, "pairs")


def learn_boundaries(docs: DataFrame, text: str = "text") -> SentenceModel:
    """Learn from whole texts; null and empty texts have no tokens."""
    types = materialize(type_counts(token_counts(docs, text)), "types")
    totals = types.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).first()
    total, dotted = totals["n"] or 0, totals["dotted"] or 0
    scores = materialize(abbreviation_scores(types, total, dotted), "abbreviations")
    pairs = described_pairs(docs.select(F.lit(0).alias("__k"), text), scores, "__k", text)

    # --- words that begin sentences -------------------------------------------
    sure = (F.col("form") == "end") | ((F.col("form") == "dot") & ~F.col("short") & ~F.col("single") & ~F.col("number"))
    behind = pairs.where(sure).groupBy("t2").agg(F.sum("c").alias("both"))
    behind = materialize(behind, "behind")
    breaks = F.lit(float(behind.agg(F.sum("both")).first()[0] or 0))
    whole = F.lit(float(total))
    starts = behind.join(types.select(F.col("type").alias("t2"), F.col("n").cast("double").alias("second")), "t2")
    often = F.col("both") / breaks > F.col("second") / whole
    ratio = likelihood_ratio(F.col("both").cast("double"), breaks, F.col("second"), whole)
    starters = materialize(starts.where(often & (ratio >= STARTER)).select("t2"), "starters")

    # --- initials and numbers that belong to the next word ----------------------
    held = pairs.where((F.col("form") == "dot") & (F.col("single") | F.col("number")))
    held = held.groupBy("t1", "t2").agg(F.sum("c").cast("double").alias("both"))
    held = held.join(types.select(F.col("type").alias("t1"), F.col("dotted").cast("double").alias("first")), "t1")
    held = held.join(types.select(F.col("type").alias("t2"), F.col("n").cast("double").alias("second")), "t2")
    ratio = likelihood_ratio(F.col("both"), F.col("first"), F.col("second"), whole)
    often = F.col("both") / F.col("first") > F.col("second") / whole
    collocations = materialize(held.where(often & (ratio >= COLLOCATION)).select("t1", "t2"), "collocations")

    return SentenceModel(types, scores, starters, collocations)


def decide(pairs: DataFrame, model: SentenceModel) -> DataFrame:
    """(last, first, c, ends): whether a sentence ends between the two tokens, which the model need not know."""
    case = model.types.select(F.col("type").alias("t2"), "lower", "upper_inside", "upper")
    followed = pairs.groupBy("t2").agg(F.count("*").alias("__n"))
    case = materialize(case.join(followed, "t2").join(model.starters.withColumn("starts", F.lit(True)), "t2", "left"), "case")
    rows = salted_lookup(pairs, case, ["t2"], "__n", ["t1"], "left", sizes=case)
    rows = rows.join(model.collocations.withColumn("held", F.lit(True)), ["t1", "t2"], "left")
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    starts, held = F.coalesce("starts", F.lit(False)), F.coalesce("held", F.lit(False))
    # What the case of the next word says: it begins a sentence, it does not, or nothing.
    seen_lower, seen_upper = F.coalesce("lower", F.lit(0)) > 0, F.coalesce("upper", F.lit(0)) > 0
    begins = upper & seen_lower & (F.coalesce("upper_inside", F.lit(0)) == 0)
    goes_on = lower & seen_upper
    initial_of_name = F.col("single") & upper & ~seen_lower
    unsure = F.col("single") | F.col("number")
    ends = (
        F.when(F.col("form") == "end", True)
        .when(F.col("short") | (F.col("form") == "dots"), begins | (upper & starts))
        .when(held & ~starts, False)
        .when(unsure & goes_on, False)
        .when(initial_of_name & ~begins & ~starts, False)
        .otherwise(True)
    )
    return rows.select("last", "first", "c", ends.alias("ends"))


def no_ends(docs: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, goes_on): the possible ends of a text, by number, that are none."""
    places = materialize(possible_ends(docs, key, text), "places")  # of all sentences, used twice
    decided = decide(_described(places, model.abbreviations), model)
    pairs = materialize(decided.where("NOT ends").select("last", "first", "c"), "no-ends")
    found = salted_lookup(places, pairs, ["last", "first"], "c", [key, "at"], sizes=pairs)
    # Bounded by the pieces of one text.
    return found.groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("goes_on"))


def with_sentences(docs: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text", out: str = "sentences") -> DataFrame:
    """Add the sentences of every text, white space at both ends removed; none for a null or blank text.

    ``key`` is unique.
    """
    found = docs.join(no_ends(docs, model, key, text), key, "left")

    def bind(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def joined(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(p) - 1)
        goes_on = F.coalesce("goes_on", F.array().cast("array<int>"))
        starts = F.filter(numbers, lambda i: (i == 0) | ~F.array_contains(goes_on, i - 1))
        return bind(
            F.concat(starts, F.array(F.size(p))),
            lambda s: F.transform(
                F.slice(s, F.lit(1), F.size(s) - 1),
                lambda begin, k: strip(F.array_join(F.slice(p, begin + 1, F.get(s, k + 1) - begin), "")),
            ),
        )

    sentences = F.filter(bind(pieces(F.coalesce(F.col(text), F.lit(""))), joined), lambda s: s != "")
    return found.select(*docs.columns, sentences.alias(out))
