"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.  DataFrame functions only.

A source's words, in a permuted order of its documents and as often as they may be repeated, are one
long stream, cut into blocks.  The mix takes a source's quota of them.  The blocks taken are split among
the output shards by halves: at each node of the tree a random half of its blocks, that is a multivariate
hypergeometric draw of the sources' quotas, goes to either side, until a node is a shard.  So shards hold
near-equal numbers of blocks, quotas are exact, and no block is drawn twice.  A document goes, whole, to
the shard of the block in which it starts, and takes its place there in a local shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.shared import written

#: Words of a shard, about, and the levels of the tree: 2 ** levels shards.
SHARD_WORDS, MIN_LEVELS, MAX_LEVELS = 1 << 24, 4, 12
#: Blocks of the whole mix, about, and of a shard at least; each source may add one.  At most 16 << MAX_LEVELS are split in one task.
BLOCKS, SHARD_BLOCKS = 4096, 16
#: Ranges of the permuted order in which a source's words are summed before documents are placed.
RANGES = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """(src, words, target) from (src, words), one row for each source.

    Targets are in proportion to ``weights`` (repeating, sources by code point, null last) and sum to
    ``share`` of all words; none exceeds ``repeats`` times its source, what is over being reshared by
    weight.  Once the sources with the least room for their weight are full, the others' targets are
    one common level times their weights: the sources are sorted by that room, and the level is the
    first that fits all sources not yet full."""
    of_all = Window.partitionBy()  # one row for each source
    place = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.select("src", "words", (F.col("words") * float(repeats)).alias("cap"), weight.alias("w"))
    t = t.withColumn("room", F.col("cap") / F.col("w"))
    by_room = Window.orderBy("room", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.sum("words").over(of_all) * share).alias("total"),
        F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)).alias("full"),
        (F.sum("w").over(of_all) - F.coalesce(F.sum("w").over(by_room), F.lit(0.0))).alias("open"),
    )
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "src", "level"))).over(of_all)["level"])
    return t.select("src", "words", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def split(blocks: DataFrame, levels: int, seed: int) -> DataFrame:
    """Add ``shard`` to (src_key, block): at each level a random half of every node's blocks goes left."""
    node = blocks.withColumn("shard", F.lit(0))
    for level in range(levels):
        drawn = F.xxhash64(F.lit(seed), F.lit(level), "src_key", "block")
        order = Window.partitionBy("shard").orderBy(drawn, "src_key", "block")
        rank, half = F.row_number().over(order), F.floor((F.count(F.lit(1)).over(Window.partitionBy("shard")) + 1) / 2)
        node = node.select("src_key", "block", (F.col("shard") * 2 + (rank > half).cast("int")).alias("shard"))
    return node


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 7,
    levels: int | None = None,
    blocks: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The part of each row of ``docs`` in the mix: doc_id, source, ``carry``, size, source_size, target,
    and draws, an array of (epoch, block, shard, words), one for each time that the mix takes the row: the
    block in which it starts, the shard which the tree gave that block, and how many of its words are taken,
    from the first on.  Only where a source's quota ends is that less than all.

    All words that the draws of a source name add up to its target, rounded; a row's words are named at
    most ``repeats`` times.  Reruns agree, as order and draws come from hashes of ids, sizes and ``seed``.
    A null text has size 0 and no draws; null ids and repeated rows are rows like any other; a null
    source is a source of its own, the last.  An empty table gives an empty result.  Sources are a
    column of modest variety: one row for each is handled by one task.  The number of shards follows from
    the words of the mix unless ``levels`` gives it.
    """
    row = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    more = [F.col(c).alias(f"_{k}") for k, c in enumerate(carry)]
    rows = docs.select(*row, *more).withColumn("src_key", F.xxhash64("source", F.col("source").isNull()))
    # Place in the source's permuted order: a range of hashes, then the hash.
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("_range", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(RANGES)).cast("int"))
    parts = written(rows.groupBy("src_key", "source", "_range").agg(F.sum("size").alias("words")), "ranges")
    sizes = parts.groupBy(F.col("source").alias("src")).agg(F.sum("words").alias("words"))
    goal = targets(sizes, weights, share, repeats).withColumn("src_key", F.xxhash64("src", F.col("src").isNull()))
    goal = goal.select("src_key", F.col("words").alias("source_size"), "target", F.round("target").cast("long").alias("quota"))
    goal = written(goal, "targets")
    total = goal.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    if levels is None:
        levels = min(MAX_LEVELS, max(MIN_LEVELS, (total // SHARD_WORDS).bit_length()))
    blocks = blocks or max(BLOCKS, SHARD_BLOCKS << levels)
    goal = goal.withColumn("block_words", F.lit(max(1, -(-total // blocks))))

    tree = goal.filter("quota > 0").select("src_key", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div block_words"))).alias("block"))
    tree = split(tree, levels, seed).groupBy("src_key").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("_of"))
    tree = tree.select("src_key", F.transform("_of", lambda x: x["shard"]).alias("_shards"))  # BLOCKS + sources numbers in all
    goal = goal.join(tree, "src_key", "left")

    # Sizes are counted again rather than written with what is carried along.
    before = Window.partitionBy("src_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("src_key", "_range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("src_key", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, ["src_key", "_range"]).join(goal, "src_key")
    placed = placed.withColumn("_at", F.col("_base") + F.col("_in"))
    spans = f"transform(sequence(0, {repeats} - 1), e -> struct(e as epoch, _at + e * source_size as lo, least(_at + e * source_size + size, quota) as hi))"
    draw = "struct(s.epoch as epoch, s.lo div block_words as block, _shards[int(s.lo div block_words)] as shard, s.hi - s.lo as words)"
    draws = F.expr(f"transform(filter({spans}, s -> s.hi > s.lo), s -> {draw})")
    carried = [F.col(f"_{k}").alias(c) for k, c in enumerate(carry)]
    return placed.select("doc_id", "source", *carried, "size", "source_size", "target", draws.alias("draws"))


def taken(mix: DataFrame) -> Column:
    """Words of a row in the mix, repeats counted."""
    return F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])


def place(draw: Column, doc_id: Column, size: Column, seed: int = 7) -> Column:
    """A draw's place in its shard's shuffle, a hash; places order a shard's rows."""
    return F.xxhash64(F.lit(seed), draw["shard"], draw["epoch"], draw["block"], doc_id, size)


def sharded(mix: DataFrame, seed: int = 7) -> DataFrame:
    """One row for each draw, shard by shard, in the order of its shard's shuffle: the columns of ``mix``
    without draws, and epoch, block, shard, words, place.  A shard may be written by several tasks."""
    rows = mix.select("*", F.explode("draws").alias("draw"))
    rows = rows.select("*", "draw.*", place(F.col("draw"), F.col("doc_id"), F.col("size"), seed).alias("place")).drop("draw", "draws")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
