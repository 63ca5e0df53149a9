"""Back-off n-gram model for texts it has not seen (interpolated Kneser-Ney, three discounts per order).

Fitting reads the texts once: the counts of the highest order are grouped with
combining before the shuffle, and every lower order is made from the distinct
n-grams above it (its counts say how many different tokens stand before an
n-gram).  A model is a few tables of counts and contexts and a handful of numbers;
it is written once and can be saved and loaded.

    p(w | c) = max(count - D, 0) / total(c) + gamma(c) * p(w | shorter c)

The shortest context is empty and backs off to one share for each known token and
one for all unknown ones, so every token has a probability and those of a context
sum to 1.

Scoring looks the distinct n-grams up, not the tokens; tokens are joined once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.tokens import token_list
from textloom.operators import cross_fit, packs
from textloom.operators.ranking import salted_lookup
from textloom.session import BROADCAST_ROWS, materialize, release

#: Stands before the first token of a text; no token is empty.
PAD = ""


def words(order: int) -> list[str]:
    return [f"w{i + 1}" for i in range(order)]


def padded_ngrams(docs: DataFrame, order: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, w1..): the n-gram that ends at each token, ``PAD`` before the first.  Built inside the row."""
    tokens = docs.select(key, token_list(F.col(text)).alias("__t"))

    def at(i: Column) -> Column:
        return F.when(i >= 0, F.get("__t", i)).otherwise(F.lit(PAD))

    grams = F.transform(
        F.col("__t"),
        lambda token, i: F.struct(i.alias("pos"), *[at(i - (order - 1 - j)).alias(w) for j, w in enumerate(words(order))]),
    )
    return tokens.select(key, F.inline(grams))


def padded_counts(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(w1.., c) over all tokens."""
    grams = padded_ngrams(docs.select(F.lit(0).alias("__k"), text), order, "__k", text)
    return grams.groupBy(*words(order)).agg(F.count("*").alias("c"))


@dataclass(frozen=True)
class Discounts:
    """What is taken from counts of 1, 2 and more."""

    one: float
    two: float
    more: float

    @staticmethod
    def estimate(n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From how many n-grams have the counts 1 to 4; a count that none has is not discounted."""
        if not n1:
            return Discounts(0.0, 0.0, 0.0)
        y = n1 / (n1 + 2.0 * n2)

        def of(k: int, n: int, above: int) -> float:
            return min(max(k - (k + 1) * y * above / n, 0.0), float(k)) if n else 0.0

        return Discounts(of(1, n1, n2), of(2, n2, n3), of(3, n3, n4))

    def of(self, count: Column) -> Column:
        return F.when(count == 1, self.one).when(count == 2, self.two).otherwise(self.more)


@dataclass(frozen=True)
class BackoffModel:
    """Tables and numbers by order: grams (w1..wk, c), contexts (w1..wk-1, total, gamma), discounts.

    ``total`` and ``gamma`` belong to the empty context, ``known`` is the number of known tokens.
    """

    order: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    discounts: dict[int, Discounts]
    total: int
    gamma: float
    known: int

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Below ``path``: one folder per table and ``numbers``, written last."""
        spark = self.grams[1].sparkSession
        for k in range(1, self.order + 1):
            self.grams[k].write.mode(mode).parquet(f"{path}/grams-{k}")
            if k > 1:
                self.contexts[k].write.mode(mode).parquet(f"{path}/contexts-{k}")
        rows = [
            (k, d.one, d.two, d.more, self.total, self.gamma, self.known) for k, d in sorted(self.discounts.items())
        ]
        spark.createDataFrame(rows, NUMBERS).coalesce(1).write.mode(mode).parquet(f"{path}/numbers")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BackoffModel:
        rows = spark.read.parquet(f"{path}/numbers").collect()  # one row per order
        order = max(r["k"] for r in rows)
        return BackoffModel(
            order,
            {k: spark.read.parquet(f"{path}/grams-{k}") for k in range(1, order + 1)},
            {k: spark.read.parquet(f"{path}/contexts-{k}") for k in range(2, order + 1)},
            {r["k"]: Discounts(r["one"], r["two"], r["more"]) for r in rows},
            rows[0]["total"],
            rows[0]["gamma"],
            rows[0]["known"],
        )


NUMBERS = "k int, one double, two double, more double, total long, gamma double, known long"


def _kinds() -> list[Column]:
    """How many continuations of a context have the counts 1, 2 and more."""
    c = F.col("c")
    return [
        F.count_if(c == 1).alias("n1"),
        F.count_if(c == 2).alias("n2"),
        F.count_if(c > 2).alias("n3"),
        F.sum("c").alias("total"),
    ]


def _gamma(d: Discounts) -> Column:
    return (F.lit(d.one) * F.col("n1") + F.lit(d.two) * F.col("n2") + F.lit(d.more) * F.col("n3")) / F.col("total")


def fit_backoff(docs: DataFrame, order: int = 3, text: str = "text") -> BackoffModel:
    """Fit on whole texts; null and empty texts have no tokens.  Without any token there is nothing to fit."""
    grams, contexts, discounts = {}, {}, {}
    counts = padded_counts(docs, order, text)
    for k in range(order, 0, -1):
        if k < order:
            # How many different tokens stand before the n-gram: each is one row of the order above.
            above = grams[k + 1].select(*[F.col(w).alias(f"w{i}") for i, w in enumerate(words(k + 1))])
            counts = above.groupBy(*words(k)).agg(F.count("*").alias("c"))
        grams[k] = materialize(counts, f"backoff-{k}")
        n = grams[k].agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        discounts[k] = Discounts.estimate(n["n1"], n["n2"], n["n3"], n["n4"])
        if k > 1:
            by_context = grams[k].groupBy(*words(k - 1)).agg(*_kinds())
            by_context = by_context.select(*words(k - 1), "total", _gamma(discounts[k]).alias("gamma"))
            contexts[k] = materialize(by_context, f"contexts-{k}")
    top = grams[1].agg(*_kinds(), F.count("*").alias("known")).select("*", _gamma(discounts[1]).alias("gamma")).first()
    if not top["known"]:
        raise ValueError("there are no tokens to fit")
    return BackoffModel(order, grams, contexts, discounts, top["total"], top["gamma"], top["known"])


def _share(found: str, total: Column, d: Discounts) -> Column:
    """The part of the probability that the n-gram's own count gives; 0 if it was not seen."""
    c = F.col(found)
    return F.coalesce((c - d.of(c)) / total, F.lit(0.0))


def _extend(shorter: DataFrame, ngrams: DataFrame, model: BackoffModel, k: int) -> DataFrame:
    """p1..pk of distinct n-grams of k words from p1..pk-1 of their last k - 1 words."""
    tail = shorter.select(*[F.col(w).alias(f"w{i + 2}") for i, w in enumerate(words(k - 1))], *[f"p{j}" for j in range(1, k)])
    grams = model.grams[k].withColumnRenamed("c", "__c")
    followers = model.grams[k].groupBy(*words(k - 1)).agg(F.count("*").alias("__n"))
    contexts = materialize(model.contexts[k].join(followers, words(k - 1)), "followed")
    rows = ngrams.join(tail, words(k)[1:]).join(grams, words(k), "left")
    rows = salted_lookup(rows, contexts, words(k - 1), "__n", [f"w{k}"], "left", sizes=contexts)
    own = _share("__c", F.col("total"), model.discounts[k])
    longer = own + F.coalesce("gamma", F.lit(1.0)) * F.col(f"p{k - 1}")
    return rows.select(*words(k), "n", *[f"p{j}" for j in range(1, k)], longer.alias(f"p{k}"))


def ngram_probabilities(ngrams: DataFrame, model: BackoffModel) -> DataFrame:
    """Add p1..: the probability of the last word after no, one, two .. words, for distinct n-grams (w1.., n).

    Each order is looked up for distinct n-grams of its own length.
    """
    steps = {model.order: ngrams}
    for k in range(model.order - 1, 0, -1):
        tails = steps[k + 1].select(*[F.col(w).alias(f"w{i}") for i, w in enumerate(words(k + 1))], "n")
        steps[k] = materialize(tails.groupBy(*words(k)).agg(F.sum("n").alias("n")), f"tails-{k}")
    base = F.lit(model.gamma) / F.lit(float(model.known + 1))
    own = _share("__c", F.lit(float(model.total)), model.discounts[1])
    found = steps[1].join(model.grams[1].withColumnRenamed("c", "__c"), "w1", "left").select("w1", "n", (own + base).alias("p1"))
    for k in range(2, model.order + 1):
        found = _extend(materialize(found, f"scored-{k - 1}"), steps[k], model, k)
    return found


def score_tokens(docs: DataFrame, model: BackoffModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, p1.., one per order) for every token of whole texts, seen or not."""
    grams = words(model.order)
    rows = padded_ngrams(docs, model.order, key, text)
    distinct = materialize(rows.groupBy(*grams).agg(F.count("*").alias("n")), "distinct")
    scored = materialize(ngram_probabilities(distinct, model), "scored")
    release(distinct)
    found = salted_lookup(rows, scored, grams, "n", [key, "pos"], sizes=scored)
    return found.select(key, "pos", *[f"p{k}" for k in range(1, model.order + 1)])


def document_perplexity(scored: DataFrame, key: str = "doc_id", column: str = "p3") -> DataFrame:
    """(key, n, mean_nll, median_nll, perplexity) from token probabilities."""
    nll = -F.ln(column)
    sums = scored.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(nll).alias("mean_nll"), F.percentile(nll, 0.5).alias("median_nll")
    )
    return sums.withColumn("perplexity", F.exp("mean_nll"))


def cross_fitted(docs: DataFrame, fold: Column, folds: Sequence[int], order: int = 3, key: str = "doc_id") -> DataFrame:
    """Token probabilities of every document under a model fitted on the documents of the other folds.

    Models of three words are counted in packs, all folds at once (``cross_fit``), and the probabilities
    are worked out as lists of a document where they are read."""
    numbered = docs.withColumn("__fold", fold)
    if order != 3:
        return _cross_fitted_rows(numbered, folds, order, key)
    corpus = packs.numbered(numbered, key, part="__fold")
    counts = cross_fit.count(corpus, folds)
    models = {}
    for number in folds:
        discounts = {k: Discounts.estimate(*counts.histograms[k][number][:4]) for k in (1, 2, 3)}
        one, two, _, _, total, known = counts.histograms[1][number]
        if not known:
            raise ValueError("there are no tokens to fit")
        d = discounts[1]
        gamma = (d.one * one + d.two * two + d.more * (known - one - two)) / total
        models[number] = cross_fit.Numbers({k: (d.one, d.two, d.more) for k, d in discounts.items()}, total, gamma, known)
    lists = cross_fit.probabilities(counts, models, key)
    rows = lists.select(key, "p2", "p3", F.posexplode_outer("p1").alias("pos", "p1"))
    rows = rows.select(key, "pos", "p1", *[F.get(p, F.col("pos")).alias(p) for p in ("p2", "p3")])
    rows._textloom_figures = cross_fit.figures(counts, models, key)  # for ``document_nll``
    rows._textloom_keys = corpus.chunks.where(F.col("part").isin(list(folds))).select(F.explode("keys").alias(key))
    return rows


def _cross_fitted_rows(numbered: DataFrame, folds: Sequence[int], order: int, key: str) -> DataFrame:
    whole = None
    for number in folds:
        model = fit_backoff(numbered.where(F.col("__fold") != number), order)
        # Written, so that the shuffled tokens and the model of a fold are gone before those of the next.
        scored = materialize(score_tokens(numbered.where(F.col("__fold") == number), model, key), "fold")
        for part in (*model.grams.values(), *model.contexts.values()):
            release(part)
        whole = scored if whole is None else whole.unionByName(scored)
    return whole


def document_nll(scored: DataFrame, orders: Sequence[int], key: str = "doc_id") -> DataFrame:
    """(key, n, nll_1.., median_nll): mean -ln p of every order, and the median of the highest.

    Documents whose key no other has lie together already (see ``cross_fitted``) and are not moved."""
    figures = getattr(scored, "_textloom_figures", None)
    if figures is None or max(orders) != 3:
        return _grouped_nll(scored, orders, key)
    counted = scored._textloom_keys.groupBy(key).count().where("count > 1")
    repeated = materialize(counted.select(F.col(key).alias("__key")), "repeated")
    several = repeated.count()
    alone = figures.select(key, "n", *[f"nll_{k}" for k in orders], "median_nll")
    if not several:
        return alone
    repeated = F.broadcast(repeated) if several <= BROADCAST_ROWS else repeated
    same = F.col(key).eqNullSafe(F.col("__key"))
    others = _grouped_nll(scored.join(repeated, same, "left_semi"), orders, key)
    return alone.join(repeated, same, "left_anti").unionByName(others)


def _grouped_nll(scored: DataFrame, orders: Sequence[int], key: str) -> DataFrame:
    means = [F.avg(-F.ln(f"p{k}")).alias(f"nll_{k}") for k in orders]
    return scored.groupBy(key).agg(F.count("*").alias("n"), *means, F.percentile(-F.ln(f"p{max(orders)}"), 0.5).alias("median_nll"))
