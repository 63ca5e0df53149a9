"""Labels and scores of token spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the suffix of a mixed sample's source that carries the
# character range of its generated part.
RANGE = r"__[\[\]]*\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*[\[\]]*$"


def span_arrays(spans: DataFrame, key: str) -> DataFrame:
    """Span rows -> one ordered array per document (bounded by its text)."""
    rows = F.sort_array(F.collect_list(F.struct("span_no", "start", "end")))
    return spans.groupBy(key).agg(rows.alias("r")).select(
        key, F.transform("r", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )


def token_to_char_spans(spans: Column, offsets: Column) -> Column:
    """Token ranges -> character ranges; ranges outside the text are skipped."""
    n = F.size(offsets)
    valid = F.filter(
        spans, lambda s: (s["start"] < n) & (s["end"] <= n) & (s["start"] < s["end"])
    )
    return F.transform(
        valid,
        lambda s: F.struct(
            F.get(offsets, s["start"])["start"].alias("start"),
            F.get(offsets, s["end"] - 1)["end"].alias("end"),
        ),
    )


def span_labels(label: Column, source: Column, spans: Column, offsets: Column) -> Column:
    """Label per span.

    Unmixed texts repeat their label.  In a mixed text (label 2) a span fully
    inside the generated range is 1 (also an empty span), one that touches it
    is 2, any other 0; a range that cannot be read gives 0, none gives 2.
    """
    low = F.regexp_extract(source, RANGE, 1).try_cast("int")
    high = F.regexp_extract(source, RANGE, 2).try_cast("int")

    def classify(span: Column) -> Column:
        tokens = F.slice(offsets, span["start"] + 1, span["end"] - span["start"])
        inside = F.forall(tokens, lambda t: (t["start"] >= low) & (t["end"] <= high))
        touches = F.exists(tokens, lambda t: (t["start"] < high) & (t["end"] > low))
        return F.when(inside, 1).when(touches, 2).otherwise(0)

    n = F.size(spans)
    return (
        F.when(label != 2, F.array_repeat(label, n))
        .when(~source.contains("__"), F.array_repeat(F.lit(2), n))
        .when(low.isNull() | high.isNull(), F.array_repeat(F.lit(0), n))
        .otherwise(F.transform(spans, classify))
    )


def fold_fusion_label(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.when(x == 2, 1).otherwise(x))


def document_score(spans: DataFrame, key: str, probability: Column) -> DataFrame:
    """Mean span probability in percent and the ordered spans of a document."""
    entry = F.struct("span_no", "start", "end", (probability * 100).alias("percent"))
    return spans.groupBy(key).agg(
        (F.avg(probability) * 100).alias("avg"), F.sort_array(F.collect_list(entry)).alias("spans")
    )
