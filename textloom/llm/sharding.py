"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks, racks in regions.  A document descends from level to
level.  At every node each child draws -ln(u) / weight, with u from a hash of the
document's key and the child's name, and the smallest draw wins; so a child gets
its share of the weights.  The draw of a child depends on its own name and weight
only: when weights change, documents move only into subtrees whose weight grew or
out of those whose weight shrank, and subtrees that kept their weights exchange
nothing.

A tree grows by regions.  A new shard is a region with one rack and one shard, so
at the top level one new child draws, all others draw what they drew before, and
documents move into the new shard only.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.session import materialize

LAW = "key"
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: Ranges of a shard within which its rows are numbered, a power of 16; copies of a row that are made in one task.
CELLS, BLOCK = 16**3, 1 << 16


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        flat = [w for region in self.regions for rack in region for w in rack]
        if any(w < 0 for w in flat) or not sum(flat) > 0:
            raise ValueError("weights are not negative, and one of them is positive")

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        """So many regions, racks a region and shards a rack, all of weight 1."""
        return Tree((((1.0,) * shards,) * racks,) * regions)

    def grow(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, which takes rows only into itself."""
        return Tree(self.regions + (((weight,),),))

    def reweigh(self, shard: int, weight: float) -> Tree:
        """The tree with another weight of one shard."""
        numbers = iter(range(self.size))
        return Tree(
            tuple(tuple(tuple(weight if next(numbers) == shard else w for w in rack) for rack in region) for region in self.regions)
        )

    @property
    def size(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, null for the weight 0; u in (0, 1) is made of the first 48 bits of an md5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", key, name).cast("binary")), 1, 12), 16, 10)
    u = (digits.cast("double") + 0.5) / float(16**12)
    return F.when(weight > 0, -F.log(u) / weight)


def _winner(key: Column, parent: Column | None, weights: Column) -> Column:
    """Number of the child with the smallest draw; of equal draws the first."""

    def child(weight: Column, i: Column) -> Column:
        name = i.cast("string") if parent is None else F.concat_ws("/", parent, i.cast("string"))
        drawn = draw(key, name, weight)
        return F.when(drawn.isNotNull(), F.struct(drawn.alias("draw"), i.alias("i")))

    return F.array_min(F.transform(weights, child))["i"]


def _literal(values) -> Column:
    if isinstance(values, tuple):
        return F.array(*[_literal(v) for v in values])
    return F.lit(values)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def descend(key: Column, tree: Tree) -> Column:
    """Struct of region, rack (within the region) and shard of a key."""
    by_rack = tuple(tuple(float(sum(shards)) for shards in racks) for racks in tree.regions)
    by_region = tuple(sum(racks) for racks in by_rack)
    first, at = [], 0
    for racks in tree.regions:
        first.append(tuple(at + sum(len(shards) for shards in racks[:k]) for k in range(len(racks))))
        at += sum(len(shards) for shards in racks)

    def found(name: Column, region: Column, rack: Column) -> Column:
        leaf = _winner(name, F.concat_ws("/", region, rack), F.get(F.get(_literal(tree.regions), region), rack))
        shard = F.get(F.get(_literal(tuple(first)), region), rack) + leaf
        return F.struct(region.alias("region"), rack.alias("rack"), shard.alias("shard"))

    def in_region(name: Column, region: Column) -> Column:
        rack = _winner(name, region.cast("string"), F.get(_literal(by_rack), region))
        return _let(rack, lambda k: found(name, region, k))

    def from_top(name: Column) -> Column:
        return _let(_winner(name, None, _literal(by_region)), lambda r: in_region(name, r))

    return _let(F.coalesce(key.cast("string"), F.lit("")), from_top)


def place(rows: DataFrame, tree: Tree, key: Column, out: str = "__place") -> DataFrame:
    """Add the struct of region, rack (within the region) and shard as ``out``.

    A projection: nothing is shuffled.  A null key counts as the empty string, so
    rows without a key share one shard.
    """
    return rows.withColumn(out, descend(key, tree))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: key, size, text_crc32, region, rack, shard, slot, grown_shard.

    The key and the tree alone decide the shard; slot numbers the rows of a shard
    from 0 without gaps, by a hash of key and checksum.  Rows that agree in all of
    these are numbered in any order.  Null and empty texts have size ``ROW_BYTES``
    and checksum 0, a null key counts as the empty string.  Equal texts under
    different keys are not kept together.  grown_shard is the shard with one more
    shard in the tree.  An empty table gives no rows; other columns are not looked
    at, whatever their names.

    Equal rows are counted before the shuffle, so copies that make up a third of
    all rows are one row per task, and are written out in blocks of ``block``.  A
    shard is numbered in ``CELLS`` ranges of the hash, never in one task.
    """
    body = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{key}`").alias("__key"),
        row_size(body).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("__key", "size", "text_crc32").agg(F.count("*").alias("__n"))
    name = F.coalesce(F.col("__key").cast("string"), F.lit(""))
    order = F.substring(F.md5(F.concat_ws(":", name, F.col("text_crc32").cast("string")).cast("binary")), 1, 16)
    digits = len(f"{CELLS - 1:x}")
    placed = place(place(counted, tree, F.col("__key")), tree.grow(), F.col("__key"), "__grown").withColumn("__order", order)
    placed = placed.select("*", F.col("__place.shard").alias("__shard"), F.substring("__order", 1, digits).alias("__cell"))
    placed = materialize(placed, "placed")

    # At most shards x CELLS rows, whatever the input.
    totals = placed.groupBy("__shard", "__cell").agg(F.sum("__n").alias("__total"))
    earlier = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__shard", "__cell", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    before = (
        Window.partitionBy("__shard", "__cell")
        .orderBy("__order", "__key", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.join(starts, ["__shard", "__cell"]).withColumn(
        "__slot", F.col("__start") + F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    # Copies become blocks, blocks are dealt out, then become rows.
    blocks = numbered.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / block))))
    dealt = blocks.repartition("__order", "__block")
    last = F.least(F.col("__n"), (F.col("__block") + 1) * block) - 1
    copies = dealt.withColumn("__copy", F.explode(F.sequence(F.col("__block") * block, last)))
    return copies.select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        "__place.region",
        "__place.rack",
        "__place.shard",
        (F.col("__slot") + F.col("__copy")).alias("slot"),
        F.col("__grown.shard").alias("grown_shard"),
    )


def moves(docs: DataFrame, before: Tree, after: Tree, key: str = "doc_id") -> DataFrame:
    """shard, new_shard, n: how many rows each pair of shards exchanges when the tree changes."""
    name = F.col(f"`{key}`")
    both = docs.select(descend(name, before)["shard"].alias("shard"), descend(name, after)["shard"].alias("new_shard"))
    return both.groupBy("shard", "new_shard").agg(F.count("*").alias("n"))


def write_shards(
    docs: DataFrame, tree: Tree, path: str, key: str = "doc_id", text: str = "text", files: int = 1, mode: str = "errorifexists"
) -> None:
    """Whole rows under ``path``/shard=N, each shard in about ``files`` files, so that no shard is written by one task alone."""
    placed = docs.withColumn("shard", descend(F.col(f"`{key}`"), tree)["shard"])
    deal = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(files))
    placed.repartition(tree.size * files, "shard", deal).write.mode(mode).partitionBy("shard").parquet(path)
