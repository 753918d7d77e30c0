"""Best-fit packing of tokenised documents into fixed-length sequences.

Only the lengths decide where a piece goes, and there are at most ``capacity`` different lengths.  So
the packing is planned on the histogram of lengths (a table of at most ``capacity`` rows, whatever
the corpus) and the plan is a short list of runs: so many sequences of the same filling.  Each piece
then looks its place up by its length and its rank among the pieces of that length.  The ranks are
counted in salted groups, so that no length, however frequent, is numbered by one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.bpe import encoder
from fabula.llm.shared import written

def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids (binary, little-endian
    unsigned 32-bit).  A null text counts as empty; each document ends with ``end_id``.  Only longer
    documents are cut, so that all pieces but the first are full.  The file's added tokens have their own
    ids in a text; other strings that look special are ordinary text.  ``tokenizer`` is the path of a byte-level BPE file on every machine."""

    def pieces(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs_, piece, start, length, ids = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (encode.text_ids(text) if text else b"") + end
                n = len(own) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)] if n > capacity else [0]):
                    size = min(n, capacity) if n <= capacity else (first if k == 0 else capacity)
                    docs_.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    ids.append(own[4 * at : 4 * (at + size)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of sequences, [(length, copies), ...] in order of place) that hold exactly ``histogram``.

    Pieces over a third of the capacity: the longest left takes the longest that fits beside it, so at
    most two meet in a sequence.  The others, longest first, go where they leave the least room.
    """
    left = {n: c for n, c in histogram.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    gaps: dict[int, list[list]] = defaultdict(list)  # room left: [[sequences, filling], ...]

    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            runs = left[a] // 2 if a == b else min(left[a], left[b])
            if runs:
                left[a] -= runs
                left[b] -= runs
                gaps[capacity - a - b].append([runs, [(a, 2)] if a == b else [(a, 1), (b, 1)]])
        if left[a]:
            gaps[capacity - a].append([left[a], [(a, 1)]])
            left[a] = 0
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            runs = gaps.pop(gap)
            while need and runs:
                count, filling = runs.pop()
                each = gap // s
                full = min(count, need // each)
                if full:
                    gaps[gap - each * s].append([full, [*filling, (s, each)]])
                    need -= full * each
                    count -= full
                if count and 0 < need < each:
                    gaps[gap - need * s].append([1, [*filling, (s, need)]])
                    need, count = 0, count - 1
                if count:
                    runs.append([count, filling])
            if runs:
                gaps[gap].extend(runs)
            if not need:
                break
        each = capacity // s
        if need // each:
            gaps[capacity - each * s].append([need // each, [(s, each)]])
        if need % each:
            gaps[capacity - need % each * s].append([1, [(s, need % each)]])
    return [(count, filling) for gap in sorted(gaps) for count, filling in gaps[gap]]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies in a sequence, first sequence, offset of the first copy) for every run and length."""
    out, sequence, rank = [], 0, defaultdict(int)
    for count, filling in runs:
        offset = 0
        for n, copies in filling:
            out.append((n, rank[n], copies, sequence, offset))
            rank[n] += count * copies
            offset += n * copies
        sequence += count
    return out


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length and any others but these two).

    ``pieces`` is read twice, so it should be a written table.  Lengths are from 1 to ``capacity``.
    Null and repeated ids are fine: every row is a piece of its own.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row's columns go in one struct, so that none can clash with ours.
    salted = pieces.select(
        F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), "doc_id", "piece", "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt")
    )
    counts = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    # The ranked rows are partitioned and sorted for this join already, and its other side grows with the cluster: no broadcast.
    ranked = salted.withColumn("in", F.row_number().over(order)).join(base.hint("merge"), ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("base") + F.col("in") - 1).alias("rank"))

    # The plan has a few thousand runs at most, so a length's places fit one array.
    by_length: dict[int, list] = defaultdict(list)
    for n, rank, copies, sequence, offset in places(plan(histogram, capacity)):
        by_length[n].append((rank, copies, sequence, offset))
    rows = [(n, *map(list, zip(*sorted(x), strict=True))) for n, x in by_length.items()]
    lookup = spark.createDataFrame(rows, "length long, rank0 array<long>, copies array<long>, seq array<long>, off array<long>")

    placed = ranked.join(F.broadcast(lookup), "length")
    # How many places of this length start at or before the rank: a binary search over the sorted starts.
    at = F.expr(
        "aggregate(sequence(1, 20), named_struct('lo', 0, 'hi', size(rank0)), (s, k) -> if(s.hi - s.lo <= 1, s, "
        "if(rank0[int((s.lo + s.hi) div 2)] <= rank, named_struct('lo', int((s.lo + s.hi) div 2), 'hi', s.hi), "
        "named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)))), s -> s.lo)"
    )
    placed = placed.withColumn("at", at).withColumn("k", F.expr("rank - rank0[at]"))
    return placed.select("row.*", F.expr("seq[at] + k div copies[at]").alias("sequence_id"), F.expr("off[at] + (k % copies[at]) * length").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from pieces that still carry ``ids``: sequence_id, n_tokens, n_pieces, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    out = placed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return out.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("n_tokens"), F.size("p").alias("n_pieces"), ids.alias("ids"))


def digest(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Pack ``docs`` and describe each piece's ids by their CRC-32."""
    pieces = tokenised(docs, tokenizer, capacity=capacity)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packed(pieces, capacity)
