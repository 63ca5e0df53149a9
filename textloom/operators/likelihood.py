"""Count-based token likelihoods and the features built on them.

The probability of a token given its context comes from n-gram counts of the
corpus (orders 1 to 3).  A context can be very frequent, so

* counts are partially aggregated before every shuffle,
* context totals and moments are aggregates over the distinct continuations,
  not windows over them,
* tokens look their n-gram up with ``salted_lookup``, straight from the
  document's row: one shuffle of the tokens per order,
* ``token_likelihoods`` takes its counts from ``packs``: no shuffle of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from textloom.functions.tokens import token_list
from textloom.operators import packs
from textloom.operators.ranking import (
    DIRECT_ROWS,
    first_per_group,
    groups_within,
    running_totals,
    salted_lookup,
    with_rank,
)
from textloom.session import BROADCAST_ROWS, densely_written, materialize, release

ORDERS = (1, 2, 3)

#: Shares in which the n-grams of an order are scored: more of them shuffle less at a time and read the tokens more often.
PARTS = {1: 4, 2: 6, 3: 10}


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the tokens in place of the text, written once for what reads them many times."""
    with densely_written(docs.sparkSession):
        return materialize(docs.select(key, token_list(F.col(text)).alias(text)), "tokens")


def ngram_rows(docs: DataFrame, order: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, w1..w_order): every n-gram with the position of its last
    token.  Built inside each document's row, so no window and no shuffle.
    ``text`` may hold the tokens instead (see ``tokenized``)."""
    listed = isinstance(docs.schema[text].dataType, ArrayType)
    tokens = docs.select(key, (F.col(text) if listed else token_list(F.col(text))).alias("t"))
    # The words before are taken from the list beside: compiled, which a lambda is not, and without lists of copies.
    placed = tokens.select(key, "t", F.posexplode_outer("t").alias("pos", "__w")).where(F.col("pos") >= order - 1)
    earlier = [F.get("t", F.col("pos") - (order - 1 - j)).alias(w) for j, w in enumerate(gram_columns(order)[:-1])]
    return placed.select(key, "pos", *earlier, F.col("__w").alias(gram_columns(order)[-1]))


def gram_columns(order: int) -> list[str]:
    return [f"w{j + 1}" for j in range(order)]


#: One part of several equal ones, and how many there are.
Share = tuple[int, int]
WHOLE: Share = (0, 1)


def in_share(rows: DataFrame, order: int, share: Share) -> DataFrame:
    """The n-grams of a share: all continuations of a context fall into one (for order 1 all uses of a token)."""
    part, parts = share
    hashed = F.xxhash64(*(gram_columns(order)[:-1] or gram_columns(order)))
    return rows if parts == 1 else rows.where(F.pmod(hashed, F.lit(parts)) == part)


def ngram_counts(docs: DataFrame, order: int, share: Share = WHOLE) -> DataFrame:
    """(w1.., c) over the corpus, or over a share of the n-grams."""
    names = gram_columns(order)
    # One string as the key is a narrower row than several; no token holds a space.
    grams = in_share(ngram_rows(docs, order), order, share)
    counted = grams.groupBy(F.concat_ws(" ", *names).alias("__g")).agg(F.count("*").alias("c"))
    # Cut in bytes; split_part would make a list of Java strings for every word.
    words = [F.substring_index(F.substring_index("__g", " ", j + 1), " ", -1).alias(w) for j, w in enumerate(names)]
    return counted.select(*words, "c")


def _attach(
    grams: DataFrame, order: int, per_context: Mapping[str, Callable], direct: bool | None = None
) -> DataFrame:
    """Give every n-gram the aggregates of its context.

    ``per_context`` maps a name to a function of ``over``, which turns an
    aggregate into its value for the context.  While every context is small
    enough for one task a window does it with a single shuffle; above that
    the aggregates are computed apart and joined back, with the continuations
    of a frequent context spread over several tasks.  ``direct`` says which
    way, if that is known (see ``groups_within``).
    """
    context = gram_columns(order)[:-1]
    if not context:
        whole = grams.agg(*[f(lambda a: a).alias(n) for n, f in per_context.items()])
        return grams.crossJoin(F.broadcast(whole))  # exactly one row
    if groups_within(grams, context, DIRECT_ROWS) if direct is None else direct:
        window = Window.partitionBy(*context)
        return grams.withColumns({n: f(lambda a: a.over(window)) for n, f in per_context.items()})
    sums = grams.groupBy(*context).agg(
        *[f(lambda a: a).alias(n) for n, f in per_context.items()], F.count("*").alias("__n")
    )
    return salted_lookup(grams, sums, context, "__n", [gram_columns(order)[-1]]).drop("__n")


def context_total(over: Callable[[Column], Column]) -> Column:
    return over(F.sum("c"))


def train(docs: DataFrame, order: int, share: Share = WHOLE) -> DataFrame:
    """n-gram counts, written once: this table is the trained model."""
    return materialize(ngram_counts(docs, order, share), f"ngrams{order}")


def ngram_model(counts: DataFrame, order: int) -> DataFrame:
    """(w1.., c, context_c, p): p is the share of the continuation among all
    continuations of its context (of all tokens for order 1)."""
    joined = _attach(counts, order, {"context_c": context_total})
    return joined.withColumn("p", F.col("c") / F.col("context_c"))


def with_target_ranks(model: DataFrame, order: int, direct: bool | None = None) -> DataFrame:
    """Add the 0-based rank of each continuation of its context: probability
    descending, then the token."""
    grams = gram_columns(order)
    return with_rank(model, [F.desc("c"), F.col(grams[-1])], keys=grams[:-1], direct=direct)


def top_k_continuations(model: DataFrame, order: int, k: int) -> DataFrame:
    """The ``k + 1`` most likely continuations of every context."""
    grams = gram_columns(order)
    return first_per_group(model, [F.desc("c"), F.col(grams[-1])], grams[:-1], k + 1)


def _look_up(
    rows: DataFrame, model: DataFrame, counts: DataFrame, order: int, spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """``rows`` with what ``model`` holds for their n-gram, which becomes one string ``gram``: a narrower row to shuffle."""
    names = gram_columns(order)
    rows, model, counts = (t.withColumn("gram", F.concat_ws(" ", *names)).drop(*names) for t in (rows, model, counts))
    return salted_lookup(rows, model, ["gram"], "c", spread, how, sizes=counts)


def token_likelihoods(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, p1, p2, p3) for every token but the first, which no context
    precedes; p3 starts one position later.  Long form of the matrix.

    Counts come from ``packs`` and are written as lists per document, without a row
    per token; the rows are made where they are read."""
    corpus = packs.numbered(docs, key)
    lists = packs.gram_lists(corpus, key)
    release(corpus.chunks)
    lists = lists.select(key, *packs.COUNTS, F.lit(corpus.tokens).cast("bigint").alias("tokens"))
    pos = F.col("pos")
    rows = lists.select("*", F.posexplode("n3").alias("pos", "__n")).where(pos >= 1)
    rows = rows.select(key, "pos", *[p.alias(f"p{o}") for o, p in zip(ORDERS, _probabilities(pos))])
    rows._textloom_lists = lists  # for ``likelihood_matrix``
    return rows


def _probabilities(pos: Column) -> list[Column]:
    """p1, p2, p3 of the token at a position from 1 up of the lists that ``packs.gram_lists`` makes: its count
    by how often its context is followed by anything.  p3 is NULL at position 1."""
    before = pos - 1
    return [
        F.get("n1", pos) / F.col("tokens"),
        F.get("n2", pos) / (F.get("n1", before) - F.get("ends1", before)),
        F.when(pos >= 2, F.get("n3", pos) / (F.get("n2", before) - F.get("ends2", before))),
    ]


def likelihood_matrix(likelihoods: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, matrix): one row per document, positions by orders.

    Documents whose key no other has are lists already (see ``token_likelihoods``) and are not
    moved; only the tokens of the others are grouped."""
    lists = getattr(likelihoods, "_textloom_lists", None)
    if lists is None:
        return _grouped_matrix(likelihoods, key)
    repeated = materialize(lists.groupBy(key).count().where("count > 1").select(F.col(key).alias("__key")), "repeated")
    several = repeated.count()
    whole = F.transform(F.sequence(F.lit(1), F.size("n3") - 1), lambda i: F.array(*_probabilities(i)))
    if not several:
        return lists.select(key, whole.alias("intermediate_likelihoods"))
    repeated = F.broadcast(repeated) if several <= BROADCAST_ROWS else repeated
    same = F.col(key).eqNullSafe(F.col("__key"))
    lone = lists.join(repeated, same, "left_anti").select(key, whole.alias("intermediate_likelihoods"))
    return lone.unionByName(_grouped_matrix(likelihoods.join(repeated, same, "left_semi"), key))


def _grouped_matrix(likelihoods: DataFrame, key: str) -> DataFrame:
    layers = F.array(*[F.col(f"p{o}") for o in ORDERS])
    rows = F.sort_array(F.collect_list(F.struct("pos", layers.alias("p"))))
    return likelihoods.groupBy(key).agg(rows.alias("r")).select(
        key, F.col("r.p").alias("intermediate_likelihoods")
    )


def _moments(over: Callable[[Column], Column]) -> tuple[Column, Column]:
    """sum p ln p and sum p ln^2 p of a context.  With p = c / C both follow
    from sums of c, c ln c and c ln^2 c."""
    c, log_c = F.col("c"), F.ln("c")
    s0 = over(F.sum(c)).cast("double")
    s1, s2 = over(F.sum(c * log_c)), over(F.sum(c * log_c * log_c))
    mean = s1 / s0 - F.ln(s0)
    return mean, (s2 - 2 * F.ln(s0) * s1) / s0 + F.ln(s0) * F.ln(s0)


def expectation(over: Callable[[Column], Column]) -> Column:
    return _moments(over)[0]


def variance(over: Callable[[Column], Column]) -> Column:
    mean, square = _moments(over)
    return F.greatest(square - mean * mean, F.lit(0.0))


def scoring_model(counts: DataFrame, order: int) -> DataFrame:
    """(w1.., c, p, rank, expectation, variance), ready to be looked up."""
    direct = groups_within(counts, gram_columns(order)[:-1], DIRECT_ROWS)
    per_context = {"context_c": context_total, "expectation": expectation, "variance": variance}
    share = F.col("c") / F.col("context_c")
    if direct:  # ranked first: the order of the ranks serves the sums of the context too, so a context is sorted once
        return _attach(with_target_ranks(counts, order, direct), order, per_context, direct).withColumn("p", share)
    return with_target_ranks(_attach(counts, order, per_context, direct).withColumn("p", share), order, direct)


@dataclass(frozen=True)
class ScoringModel:
    """Counts of one order and, for every n-gram, what the scores need; written once, the counts as columns of the table.

    A model of a share knows these n-grams only."""

    order: int
    counts: DataFrame
    table: DataFrame
    share: Share = WHOLE


def fit_scoring(docs: DataFrame, order: int = 2, share: Share = WHOLE) -> ScoringModel:
    if order == 1 and share != WHOLE:
        raise ValueError("all tokens are continuations of one context")
    counts = train(docs, order, share)
    model = scoring_model(counts, order)
    table = materialize(model, f"scoring{order}")
    if hasattr(model, "_textloom_path"):  # running totals that were written on the way
        release(model)
    release(counts)
    return ScoringModel(order, table.select(*gram_columns(order), "c"), table, share)


def one_at_a_time(docs: DataFrame, orders: Sequence[int] = ORDERS) -> Iterator[ScoringModel]:
    """Models of each order, for one share of its n-grams after the other and deleted when the next is asked for.

    Longer n-grams are more and wider, so they come in more shares: on disk lie the counts, the model
    and (while tokens look their n-gram up) the shuffled tokens of one share.
    """
    for order in orders:
        parts = PARTS.get(order, max(PARTS.values()))
        shares = [(part, parts) for part in range(parts)]
        if order == 1:  # fitted as a whole, since its context is the corpus, and looked up in shares
            whole = fit_scoring(docs, order)
            for share in shares:
                counts, table = (in_share(t, order, share) for t in (whole.counts, whole.table))
                yield replace(whole, counts=counts, table=table, share=share)
            release(whole.table)
            continue
        for share in shares:
            model = fit_scoring(docs, order, share)
            yield model
            release(model.table)


def score_sums(
    docs: DataFrame, model: ScoringModel, key: str = "doc_id", before: DataFrame | None = None
) -> DataFrame:
    """(key, n, log_p, log_rank, e, v): sums over the tokens of a document whose n-gram the model knows.

    ``before`` has such sums of other shares, which are added."""
    grams = in_share(ngram_rows(docs, model.order, key).where("pos >= 1"), model.order, model.share)
    found = _look_up(grams, model.table, model.counts, model.order, [key, "pos"])
    each = found.select(
        key,
        F.lit(1).cast("bigint").alias("n"),
        F.ln("p").alias("log_p"),
        F.log1p(F.col("rank").cast("double")).alias("log_rank"),
        F.col("expectation").alias("e"),
        F.col("variance").alias("v"),
    )
    each = each if before is None else each.unionByName(before)
    return each.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "log_p", "log_rank", "e", "v")])


def curvature_scores(sums: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, llr, fast_detect) from ``score_sums``."""
    return sums.select(
        key,
        "n",
        F.when(F.col("log_rank") > 0, -F.col("log_p") / F.col("log_rank")).alias("llr"),
        F.when(F.col("v") > 1e-9, (F.col("log_p") - F.col("e")) / F.sqrt("v")).alias("fast_detect"),
    )


def document_scores(docs: DataFrame, model: ScoringModel | int = 2, key: str = "doc_id") -> DataFrame:
    """(key, n, llr, fast_detect): both curvature scores of one order.

    An order instead of a model fits one on the documents themselves.

    llr = -sum ln p / sum ln(1 + rank), NULL when all ranks are 0;
    fast_detect = (sum ln p - sum E) / sqrt(sum V), NULL without variance.
    The first ``max(order - 1, 1)`` tokens have no score, nor have n-grams that
    the model has not seen (``backoff.score_tokens`` gives those a value).
    """
    if isinstance(model, int):
        model = fit_scoring(docs, model)
    return curvature_scores(score_sums(docs, model, key), key)


def scores_per_layer(docs: DataFrame, models: Iterable[ScoringModel], key: str = "doc_id") -> DataFrame:
    """(key, layer, n, llr, fast_detect) for every order.

    Models of shares of an order follow each other; the sums of a share are added to those before and
    written before the next model is asked for, so the shuffled tokens of a share are gone before those
    of the next.
    """
    whole = None
    for order, shares in groupby(models, lambda m: m.order):
        sums = None
        for model in shares:
            added = materialize(score_sums(docs, model, key, sums), "layer_sums")
            if sums is not None:
                release(sums)
            sums = added
        scored = materialize(curvature_scores(sums, key), "layer").withColumn("layer", F.lit(order))
        release(sums)
        whole = scored if whole is None else whole.unionByName(scored)
    return whole


def perplexity(docs: DataFrame, counts: DataFrame, order: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, mean_nll, median_nll) over the tokens of each document whose n-grams ``counts`` (see ``train``) holds."""
    grams = ngram_rows(docs, order, key)
    found = _look_up(grams, ngram_model(counts, order), counts, order, [key, "pos"])
    nll = -F.ln("p")
    return found.groupBy(key).agg(
        F.avg(nll).alias("mean_nll"), F.percentile(nll, 0.5).alias("median_nll")
    )


def context_cross_entropy(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Per context the sum over continuations of p_observer * -ln p_performer;
    the observer is the bigram, the performer the unigram model."""
    followers = bigrams.groupBy("w2").agg(F.count("*").alias("__n"))
    both = salted_lookup(bigrams, unigrams.join(followers, "w2"), ["w2"], "__n", ["w1"])
    return both.groupBy("w1").agg(
        F.sum(F.col("p") * -F.ln("p1")).alias("cross_entropy"), F.max("context_c").alias("context_c")
    )


@dataclass(frozen=True)
class RatioModel:
    """Probabilities of single tokens (the performer) and the cross-entropy of every context; written once."""

    counts: DataFrame
    unigrams: DataFrame
    entropies: DataFrame


def fit_ratio(docs: DataFrame) -> RatioModel:
    counts = train(docs, 1).withColumnRenamed("w1", "w2")
    unigrams = materialize(ngram_model(counts, 1).select("w2", "c", F.col("p").alias("p1")), "performer")
    bigrams = ngram_model(train(docs, 2), 2)
    return RatioModel(counts, unigrams, materialize(context_cross_entropy(bigrams, unigrams.drop("c")), "entropies"))


def cross_entropy_ratio(docs: DataFrame, model: RatioModel, key: str = "doc_id") -> DataFrame:
    """(key, ratio): mean negative log-likelihood under the performer over the
    mean cross-entropy from observer to performer."""
    # The two halves of the ratio need one look-up each and no common rows.
    pairs = ngram_rows(docs, 2, key)
    performed = salted_lookup(
        pairs.select(key, "pos", "w2"), model.unigrams, ["w2"], "c", [key, "pos"], sizes=model.counts
    )
    expected = salted_lookup(
        pairs.select(key, "pos", "w1"), model.entropies, ["w1"], "context_c", [key, "pos"], sizes=model.entropies
    )
    nll = performed.groupBy(key).agg(F.sum(-F.ln("p1")).alias("nll"))
    ce = expected.groupBy(key).agg(F.sum("cross_entropy").alias("ce"))
    return nll.join(ce, key).select(key, (F.col("nll") / F.col("ce")).alias("ratio"))


def branch_paths(
    model: DataFrame, start: DataFrame, k: int, depth: int, end_token: str = "</s>"
) -> DataFrame:
    """Breadth-first expansion of bigram continuations.

    ``start`` has (token).  Every node carries its depth, token, probability,
    order among its siblings, path, path probability and whether it lies on
    the main path (first choices only).  The end token is not followed.
    """
    best = top_k_continuations(model, 2, k - 1).select(
        F.col("w1").alias("token"),
        F.col("w2").alias("next"),
        F.col("p").alias("next_p"),
        F.col("rank").cast("int").alias("rank"),
    )
    # Both are written: the union below would work every level out again from the counts.
    best = materialize(best.where(F.col("next") != end_token), "best")
    level = start.select(
        "token",
        F.lit(0).alias("depth"),
        F.col("token").alias("path"),
        F.lit(1.0).alias("path_p"),
        F.lit(True).alias("main"),
    )
    nodes = None
    for step in range(1, depth + 1):
        level = level.join(best, "token").select(
            F.col("next").alias("token"),
            F.lit(step).alias("depth"),
            F.concat_ws(" ", "path", "next").alias("path"),
            (F.col("path_p") * F.col("next_p")).alias("path_p"),
            (F.col("main") & (F.col("rank") == 0)).alias("main"),
            F.col("rank").alias("sibling"),
            F.col("next_p").alias("p"),
        )
        level = materialize(level, "level")
        nodes = level if nodes is None else nodes.unionByName(level)
    return nodes


def filter_top_p(model: DataFrame, order: int, p: float, share: str = "p") -> DataFrame:
    """Smallest set of most likely continuations that reaches ``p``: kept while
    the shares before it stay below ``p``.  ``share`` is the column of
    probabilities, renormalised over what is kept."""
    grams = gram_columns(order)
    placed = running_totals(
        model, [F.desc("c"), F.col(grams[-1])], {"__before": F.col(share)}, keys=grams[:-1]
    )
    kept = materialize(placed.where(F.col("__before") < F.lit(p)).drop("__before"), "kept")
    joined = _attach(kept, order, {"__kept": lambda over: over(F.sum(share))})
    return joined.withColumn(share, F.col(share) / F.col("__kept")).drop("__kept")


def apply_temperature(model: DataFrame, order: int, temperature: float) -> DataFrame:
    """Add ``p_t``: p^(1/T), renormalised within the context."""
    raised = model.withColumn("__w", F.pow("p", F.lit(1.0 / temperature)))
    joined = _attach(raised, order, {"__z": lambda over: over(F.sum("__w"))})
    return joined.withColumn("p_t", F.col("__w") / F.col("__z")).drop("__w", "__z")


def likelihood_ratio_features(model: DataFrame, order: int, k: int) -> DataFrame:
    """Per n-gram: log-likelihood over log-rank, and the mean of the context's
    ``k + 1`` best probabilities over its own, with the inverse."""
    ranked = with_target_ranks(model, order)
    best = F.when(F.col("rank") <= k, F.col("p"))
    joined = _attach(ranked, order, {"top_k_mean": lambda over: over(F.avg(best))})
    log_rank = F.log1p(F.col("rank").cast("double"))
    return joined.select(
        *gram_columns(order),
        F.when(log_rank > 0, -F.ln("p") / log_rank).alias("llr_token"),
        (F.col("top_k_mean") / F.col("p")).alias("top_k_ratio"),
        (F.col("p") / F.col("top_k_mean")).alias("inverse_ratio"),
    )


# Pairwise vector operations and reductions a feature program may name.
VECTOR_OPS = {
    "v-add": lambda a, b: a + b,
    "v-sub": lambda a, b: a - b,
    "v-mul": lambda a, b: a * b,
    "v-div": lambda a, b: F.try_divide(a, b),
    "v->": lambda a, b: (a > b).cast("double"),
    "v-<": lambda a, b: (a < b).cast("double"),
}
REDUCTIONS = {
    "s-max": F.max,
    "s-min": F.min,
    "s-avg": F.avg,
    "s-var": F.var_pop,
    "s-l2": lambda x: F.sqrt(F.sum(x * x)),
}


def vector_feature(program: str) -> Column:
    """Aggregate for a program such as ``p2 v-div p1 s-avg``: a column, any
    number of (operation, column) pairs applied in turn, and a reduction."""
    first, *pairs, reduction = program.split()
    if reduction not in REDUCTIONS or len(pairs) % 2 or not set(pairs[::2]) <= set(VECTOR_OPS):
        raise ValueError(f"not a feature program: {program!r}")
    combined = reduce(
        lambda value, pair: VECTOR_OPS[pair[0]](value, F.col(pair[1])), zip(pairs[::2], pairs[1::2]), F.col(first)
    )
    return REDUCTIONS[reduction](combined)


def vector_features(vectors: DataFrame, key: str, programs: Sequence[str]) -> DataFrame:
    """One feature per program and document, standardised by the mean and the
    population deviation over all documents (0 when constant)."""
    names = [f"f{i}" for i in range(len(programs))]
    features = vectors.groupBy(key).agg(
        *[vector_feature(p).alias(n) for p, n in zip(programs, names)]
    )
    features = materialize(features, "features")  # one row per document, used twice
    moments = features.agg(
        *[F.avg(n).alias(f"__m_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"__s_{n}") for n in names],
    )
    joined = features.crossJoin(F.broadcast(moments))  # exactly one row
    return joined.select(
        key,
        *[
            F.coalesce(
                F.try_divide(F.col(n) - F.col(f"__m_{n}"), F.col(f"__s_{n}")), F.lit(0.0)
            ).alias(n)
            for n in names
        ],
    )
