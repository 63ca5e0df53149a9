"""Learned sentence boundaries on texts made by hand."""

import random

import pytest
from pyspark.sql import functions as F
from textloom.operators import sentences as st

VERBS = ["came", "went", "slept", "read", "wrote", "sang"]
NOUNS = ["house", "river", "letter", "garden", "winter", "engine"]


def corpus_texts():
    """Abbreviations, initials, ordinals and plain sentence ends, often enough to be learned."""
    random.seed(3)
    texts = []
    for i in range(150):
        noun, verb = random.choice(NOUNS), random.choice(VERBS)
        texts.append(
            f"The {noun} of Dr. Miller {verb}. The {noun} was old. He {verb} on the 3. May. "
            f"They saw J. Bach and the {random.choice(NOUNS)}, e.g. the {noun}. The end {verb}! "
            f"Then the {verb} {noun} came back. In may the {noun} {verb}. An old road went back there."
        )
    return texts


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(list(enumerate(corpus_texts())), "doc_id long, text string")
    return st.learn_boundaries(docs)


def sentences_of(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = st.with_sentences(docs, model).collect()
    return [r["sentences"] for r in sorted(found, key=lambda r: r["doc_id"])]


def test_abbreviations_are_learned(model):
    found = {r["type"] for r in model.abbreviations.where(F.col("score") >= st.ABBREVIATION).collect()}
    assert {"dr", "e.g"} <= found and not found & {"old", "back", *NOUNS, *VERBS}


def test_starters_and_collocations_are_learned(model):
    assert {r["t2"] for r in model.starters.collect()} >= {"the", "then"}
    assert {(r["t1"], r["t2"]) for r in model.collocations.collect()} >= {("3", "may"), ("j", "bach")}


def test_sentences_of_texts(spark, model):
    texts = [
        "Then Dr. Miller came. The house was old.",
        "He saw J. Bach. Then he slept.",
        "It was the 3. May. The river was old.",
        "They read, e.g. the letter.  The \"end.\" Then he came!\n\nThe winter went",
        "No ender at all",
        " \n ",
        "",
        None,
        "One? Two! Three.",
    ]
    assert sentences_of(spark, model, texts) == [
        ["Then Dr. Miller came.", "The house was old."],
        ["He saw J. Bach.", "Then he slept."],
        ["It was the 3. May.", "The river was old."],
        ["They read, e.g. the letter.", 'The "end."', "Then he came!", "The winter went"],
        ["No ender at all"],
        [],
        [],
        [],
        ["One?", "Two!", "Three."],
    ]


def test_pieces_are_the_text(spark):
    texts = ["a. b.. c?!) d e. f", "", "...", ". . .", "\n.\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(F.array_join(st.pieces(F.col("text")), "")).collect()] == texts


def test_likelihood_ratio_is_zero_for_independence_and_grows_with_dependence(spark):
    rows = spark.createDataFrame([(10.0, 100.0, 100.0, 1000.0), (50.0, 100.0, 100.0, 1000.0), (100.0, 100.0, 100.0, 1000.0)], "b double, f double, s double, t double")
    found = [r[0] for r in rows.select(st.likelihood_ratio(F.col("b"), F.col("f"), F.col("s"), F.col("t"))).collect()]
    assert abs(found[0]) < 1e-9 and 0 < found[1] < found[2]


def test_empty_corpus_learns_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = st.learn_boundaries(docs)
    assert model.abbreviations.count() == model.starters.count() == 0
    assert sentences_of(spark, model, ["Aa bb. Cc dd."]) == [["Aa bb.", "Cc dd."]]
