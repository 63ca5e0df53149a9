"""Each stage of the pipeline against a plain version, on what the stage before kept."""

from collections import Counter

import corpus_pipeline as pipeline
from test_operators import brute_groups, plain_passages, sql_over
from textloom.llm import queries, sentencepiece_bpe
from textloom.session import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert docs.columns == list(pipeline.COLUMNS)
    kept = {}
    for name, stage in pipeline.STAGES:
        found = materialize(stage(spark, docs, sf_dir), name)
        kept[name] = (docs, found)
        docs = found

    before, after = kept["language"]
    ids = {r.doc_id for r in after.collect()}
    plain = {r.doc_id for r in before.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert ids <= plain and len(ids) >= 0.99 * len(plain)

    before, after = kept["line_dedup"]
    wanted = plain_passages([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == wanted and after.count() == before.count()
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = kept["near_dedup"]
    label = brute_groups([(r.doc_id, r.text) for r in before.collect()], 5)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if label.get(r.doc_id, r.doc_id) == r.doc_id}

    before, after = kept["mixing"]
    con, sql = sql_over(before, queries.ORACLES["op5_mixing"])
    wanted = {r[0]: r[1] // r[2] for r in con.execute(f"SELECT doc_id, taken, size FROM ({sql}) WHERE taken > 0").fetchall()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(wanted)

    before, after = kept["tokens"]
    vocab = sentencepiece_bpe.vocabulary(queries.sentencepiece_model())
    wanted = Counter((r.doc_id, len(vocab.library.encode(r.text, add_bos=True, add_eos=True))) for r in before.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in after.collect()) == wanted


def test_run_and_empty_input(spark, sf_dir):
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0 and out.columns == list(pipeline.COLUMNS)
    assert pipeline.run(spark, sf_dir).count() > 0


def test_near_dedup_compares_rows_not_ids(spark, sf_dir):
    """Copies under one id go, the only copy of another text under that id stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (5, a), (5, b), (6, c), (None, c), (None, None), (7, ""), (8, None), (5, a + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.dedup_documents(spark, docs, sf_dir)
    assert kept.columns == list(pipeline.COLUMNS)
    texts = Counter(r.text for r in kept.collect())
    assert texts[b] == texts[c] == 1 and texts[a] + texts[a + " more"] == 1
    assert texts[""] == 1 and texts[None] == 2 and sum(texts.values()) == 6
