"""Row-level operators that are more than one built-in call."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import strip
from textloom.operators.ranking import first_per_group, seeded_hash

#: Fixed order of the label names; the position is the label id.
LABEL_NAMES = ("human", "ai", "fusion")
SPLITS = ("train", "eval", "test")
MAX_TEXT_CHARS = 125_000
MIN_DETECT_CHARS = 150


def apply_column(df: DataFrame, fn: Callable[..., Column], column: str, *others: str) -> DataFrame:
    """Set ``column`` to ``fn``; an existing column is passed first, a new one
    gets only the other columns."""
    given = [column, *others] if column in df.columns else list(others)
    return df.withColumn(column, fn(*[F.col(c) for c in given]))


def flat_map_rows(df: DataFrame, *variants: Sequence[Column]) -> DataFrame:
    """One output row per variant of every input row (columns named alike)."""
    rows = F.array(*[F.struct(*variant) for variant in variants])
    return df.select(F.inline(rows))


def slice_rows(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` (inclusive) to ``stop`` (exclusive) in the stated order."""
    return df.orderBy(order).offset(start).limit(max(0, stop - start))


def filter_text_length(df: DataFrame, min_length: int = 0, text: str = "text") -> DataFrame:
    """Keep ``min_length < len(stripped text) < 125000``, both strict."""
    n = F.length(strip(F.col(text)))
    return df.where((n > min_length) & (n < MAX_TEXT_CHARS))


def filter_by_equals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def filter_required_fields(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """All required columns must exist and hold a value."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise KeyError(f"missing required columns: {absent}")
    return df.dropna(subset=list(required))


def filter_detectable(
    df: DataFrame, text: str = "text", label: str = "label", score: str = "score"
) -> DataFrame:
    """Long enough text, a binary label and a finite score."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return df.where(
        (F.length(text) >= MIN_DETECT_CHARS) & F.col(label).isin(0, 1) & finite
    )


def encode_label(name: Column) -> Column:
    """Label id of a name; NULL when unknown."""
    position = F.array_position(F.array(*map(F.lit, LABEL_NAMES)), name)
    return F.when(position > 0, position - 1).cast("int")


def decode_label(label: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABEL_NAMES)), label)


def filter_in_or_null(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Membership in a list that may hold ``None``."""
    present = [v for v in values if v is not None]
    keep = F.col(column).isin(present)
    if len(present) != len(values):
        keep = keep | F.col(column).isNull()
    return df.where(keep)


def document_metadata(
    df: DataFrame,
    id: str = "id",
    text: str = "text",
    agent: Column | None = None,
    label: Column | None = None,
    kind: Column | None = None,
    **fields: Column,
) -> DataFrame:
    """Pack the describing fields and the text's sha256 into ``document``.

    Without a label, text of no agent is human and any other is AI; without a
    type it is a source text.
    """
    agent = F.lit(None).cast("string") if agent is None else agent
    default = F.when(F.coalesce(agent, F.lit("")) == "", "human").otherwise("ai")
    label = default if label is None else F.coalesce(label, default)
    kind = F.lit("source") if kind is None else F.coalesce(kind, F.lit("source"))
    packed = F.struct(
        F.col(id).cast("string").alias("id"),
        agent.alias("agent"),
        label.alias("label"),
        F.sha2(F.col(text), 256).alias("text_sha256"),
        kind.alias("type"),
        *[c.alias(n) for n, c in fields.items()],
    )
    return df.withColumn("document", packed)


def feature_record(
    df: DataFrame, features: Column, metrics: Column, metadata: Sequence[str], **constants: str
) -> DataFrame:
    """Nested record per document; empty features or metrics become NULL and
    the remaining columns go to ``metadata``."""
    return df.select(
        "document",
        *[F.lit(v).alias(n) for n, v in constants.items()],
        F.when(F.size(features) > 0, features).alias("features"),
        F.when(F.size(metrics) > 0, metrics).alias("metrics"),
        F.struct(*metadata).alias("metadata"),
    )


def explode_synthetization(items: DataFrame) -> DataFrame:
    """Collected items -> the original row and one row per (agent, branch).

    ``synthetization`` is an array of (agent, synth_chunks, synth_fulltext);
    branches that are NULL are skipped.  ``part`` > 0 marks the continuation
    of a long list, whose original row is already out.
    """
    originals = items.where("part = 0").select(
        "id_source", F.lit("human").alias("agent"), F.lit("source").alias("type"), "text"
    )
    entries = items.select("id_source", F.inline("synthetization"))
    branches = entries.select(
        "id_source",
        "agent",
        F.inline(
            F.array(
                F.struct(F.lit("chunk").alias("type"), F.col("synth_chunks.synth_text").alias("text")),
                F.struct(
                    F.lit("fulltext").alias("type"), F.col("synth_fulltext.synth_text").alias("text")
                ),
            )
        ),
    )
    return originals.unionByName(branches.where(F.col("text").isNotNull()))


def config_name(domain: Column, lang: Column, bilingual: Sequence[str]) -> Column:
    """Corpus name: domains that exist in two languages get the language added."""
    return F.when(domain.isin(list(bilingual)), F.concat_ws("_", domain, lang)).otherwise(domain)


def sort_by(df: DataFrame, *by: Column | str, reverse: bool = False, drop_key: str | None = None):
    """Global order, optionally without the sort key in the result."""
    order = [F.col(b) if isinstance(b, str) else b for b in by]
    ordered = df.orderBy(*[c.desc() if reverse else c.asc() for c in order])
    return ordered.drop(drop_key) if drop_key else ordered


def sort_by_length(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Order by ``length``, or by the size of the ids where absent; the key goes."""
    size = F.size(ids)
    key = F.coalesce(F.col("length"), size) if "length" in df.columns else size
    return df.withColumn("__length", key).orderBy("__length").drop("__length", "length")


def custom_order(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Order by the position in a fixed list; others last."""
    position = F.array_position(F.array(*map(F.lit, wanted)), F.col(column))
    return df.withColumn(
        "position", F.when(position > 0, position - 1).otherwise(len(wanted)).cast("int")
    ).orderBy("position", column)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in seeded random order (a top-n, not a full sort)."""
    return df.orderBy(seeded_hash(seed, key)).limit(n)


def limit_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], skip: int, take: int):
    """Rows ``skip`` .. ``skip + take - 1`` of every group."""
    first = first_per_group(df, order, keys, skip + take, out="__rank")
    return first.where(F.col("__rank") >= skip).drop("__rank")


def concat_splits(datasets: Iterable[DataFrame]) -> DataFrame:
    """Union of data sets with a ``split`` column; columns may differ, and only
    train, eval and test take part."""
    whole = None
    for df in datasets:
        part = df.where(F.col("split").isin(*SPLITS))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def select_agents(df: DataFrame, spec: str) -> DataFrame:
    """``"human+a+b"`` -> rows of these agents; unknown names match nothing."""
    return df.where(F.col("agent").isin(spec.split("+")))
