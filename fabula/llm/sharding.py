"""Shards of near-equal bytes by way of fixed virtual slots and a stored, versioned slot-to-shard map.

A record's slot is a hash of its id and never changes.  A map says which shard has which slot; the
first deals the slots out evenly, and each later version is an edit of the one before: slots move
from full shards to empty ones (``rebalanced``) or into one more shard (``grown``), as few and as
small as the bytes counted in them allow.  All versions stay, so any earlier placement can be read back.

A slot that holds more than a small share of all bytes or rows (a null or repeated id) is split into
pieces, dealt by row; the map has a line for each piece.  So the map has at most ``slots`` lines and
``4 * FINE`` more for each shard, whatever the table, and is the only thing that the driver sees.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabula.llm.shared import shared_dir, written

SLOTS = 8192
#: A slot over this part of a shard's even share of bytes or rows is split.
FINE = 16
#: Edits end when the fullest shard that can give and the emptiest differ by less than this part of the mean.
NEAR = 0.0005


class Unit(NamedTuple):
    """A slot, or one of the ``pieces`` of a split slot."""

    slot: int
    piece: int
    pieces: int


class Weight(NamedTuple):
    bytes: int
    rows: int


SlotMap = dict[Unit, int]


def first_map(slots: int, shards: int) -> SlotMap:
    """Runs of as many slots to each shard."""
    return {Unit(s, 0, 1): s * shards // slots for s in range(slots)}


def split(have: SlotMap, weights: dict[Unit, Weight]) -> SlotMap:
    """Lines for the pieces of split slots, each with the shard that had the slot."""
    shard_of = {u.slot: s for u, s in have.items()}
    return {u: have.get(u, shard_of[u.slot]) for u in weights}


class _Shards:
    """The slots of each shard, lightest first."""

    def __init__(self, have: SlotMap, weights: dict[Unit, Weight], shards: int):
        self.map = dict(have)
        self.load = [0] * shards
        self.held: list[list[tuple[int, Unit]]] = [[] for _ in range(shards)]
        for unit, shard in sorted(have.items()):
            self.load[shard] += weights[unit].bytes
            if weights[unit].bytes:
                self.held[shard].append((weights[unit].bytes, unit))
        for x in self.held:
            x.sort()

    def nearest(self, shard: int, want: float, below: float) -> int | None:
        """Place of the slot whose bytes are nearest to ``want`` and less than ``below``."""
        held = self.held[shard]
        at = bisect_left(held, (want,))
        near = [k for k in (at - 1, at) if 0 <= k < len(held) and held[k][0] < below]
        return min(near, key=lambda k: (abs(held[k][0] - want), k), default=None)

    def swap(self, source: int, target: int, gap: int) -> tuple[int, int] | None:
        """Places of two slots, one of each shard, that differ by nearly half of ``gap``: one walk along both lists."""
        mine, theirs = self.held[source], self.held[target]
        best, j = None, 0
        for i, (x, _) in enumerate(mine):
            while j + 1 < len(theirs) and abs(x - theirs[j + 1][0] - gap / 2) <= abs(x - theirs[j][0] - gap / 2):
                j += 1
            if j < len(theirs) and 0 < (by := x - theirs[j][0]) < gap and (best is None or abs(by - gap / 2) < best[0]):
                best = (abs(by - gap / 2), i, j)
        return best and best[1:]

    def move(self, source: int, place: int, target: int) -> None:
        size, unit = self.held[source].pop(place)
        insort(self.held[target], (size, unit))
        self.load[source] -= size
        self.load[target] += size
        self.map[unit] = target


def rebalanced(have: SlotMap, weights: dict[Unit, Weight], shards: int) -> SlotMap:
    """``have`` with slots moved from the fullest to the emptiest shard, or two slots exchanged, while that brings the two nearer.
    A shard that can do neither (one record may be larger than the difference) is left as it is."""
    state = _Shards(have, weights, shards)
    near = NEAR * sum(state.load) / shards
    full = [(-x, k) for k, x in enumerate(state.load)]
    empty = [(x, k) for k, x in enumerate(state.load)]
    heapq.heapify(full)
    heapq.heapify(empty)
    while full:
        # A shard is listed anew with each change; what was listed before is passed over.
        load, most = full[0]
        if -load != state.load[most]:
            heapq.heappop(full)
            continue
        load, least = empty[0]
        if load != state.load[least]:
            heapq.heappop(empty)
            continue
        gap = state.load[most] - load
        if gap <= near:
            break
        place = state.nearest(most, gap / 2, gap)
        if place is not None:
            state.move(most, place, least)
        elif (both := state.swap(most, least, gap)) is not None:
            back = state.held[least][both[1]][1]
            state.move(most, both[0], least)
            state.move(least, next(k for k, x in enumerate(state.held[least]) if x[1] == back), most)
        else:
            heapq.heappop(full)  # it stays as full as it is; the emptiest only gets fuller
            continue
        for k in (most, least):
            heapq.heappush(full, (-state.load[k], k))
            heapq.heappush(empty, (state.load[k], k))
    return state.map


def grown(have: SlotMap, weights: dict[Unit, Weight], shards: int) -> SlotMap:
    """``have`` with one more shard, numbered ``shards``, which takes slots from the fullest ones until it has its even share.
    No slot moves between the others."""
    state = _Shards(have, weights, shards + 1)
    share = sum(state.load) / (shards + 1)
    full = [(-x, k) for k, x in enumerate(state.load[:-1])]
    heapq.heapify(full)
    while full and state.load[-1] < share:
        load, most = heapq.heappop(full)
        room = min(share - state.load[-1], state.load[most] - state.load[-1])
        place = state.nearest(most, min(room, state.load[most] - share), room) if state.load[most] > share else None
        if place is not None:
            state.move(most, place, shards)
            heapq.heappush(full, (-state.load[most], most))
    return state.map


MAP = "slot int, piece int, pieces int, shard int"


def save(spark: SparkSession, path: str, version: int, slot_map: SlotMap) -> None:
    """Store a version; an existing one is never overwritten.  It is one file, so it is there as a whole or not at all."""
    rows = [(*unit, shard) for unit, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, SlotMap]:
    """A version and its map, the newest where none is named."""
    maps = spark.read.schema(f"{MAP}, version int").parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    rows = maps.filter(F.col("version") == version).collect()  # bounded by the slots
    return version, {Unit(r.slot, r.piece, r.pieces): r.shard for r in rows}


def records(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """A written table of slot, size (UTF-8 bytes of the text and 8 more; null as empty) and a row number for each record.
    The row number is stored, so that nothing that follows depends on how the input was read."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slot = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(slots)).cast("int")
    kept = [F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("slot")]
    return written(docs.select(*kept, *[F.col(f"`{c}`") for c in carry], F.monotonically_increasing_id().alias("row")), "records")


def _pieces(rows: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """Add ``piece``: 0, or a hash of the row where its slot is split (``pieces``: slot to number; bounded by the shards)."""
    if not pieces:
        return rows.withColumn("piece", F.lit(0))
    few = rows.sparkSession.createDataFrame(sorted(pieces.items()), "slot int, pieces int")
    cut = rows.join(F.broadcast(few), "slot", "left")
    return cut.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")


def weights(rows: DataFrame, slots: int, shards: int) -> dict[Unit, Weight]:
    """Bytes and rows of every slot, and of the pieces of those that are split."""
    sums = (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    found = {r.slot: Weight(r.bytes, r.n) for r in rows.groupBy("slot").agg(*sums).collect()}  # at most ``slots`` rows
    total = Weight(sum(w.bytes for w in found.values()), sum(w.rows for w in found.values()))
    part = shards * FINE
    share = {s: part * max(w.bytes / total.bytes, w.rows / total.rows) for s, w in found.items() if w.rows > 1}
    pieces = {s: 1 << (int(2 * x) - 1).bit_length() for s, x in share.items() if x > 1}
    out = {Unit(s, 0, 1): found.get(s, Weight(0, 0)) for s in range(slots) if s not in pieces}
    if pieces:
        cut = _pieces(rows.filter(F.col("slot").isin(list(pieces))), pieces).groupBy("slot", "piece").agg(*sums)
        have = {(r.slot, r.piece): Weight(r.bytes, r.n) for r in cut.collect()}  # at most 4 * FINE a shard
        out |= {Unit(s, p, n): have.get((s, p), Weight(0, 0)) for s, n in pieces.items() for p in range(n)}
    return out


def placed(rows: DataFrame, slot_map: SlotMap, have: dict[Unit, Weight]) -> DataFrame:
    """Add ``shard`` and ``place`` (from 0 in each shard, without gaps) to ``records``."""
    at: dict[int, int] = {}
    lines = []
    for unit, shard in sorted(slot_map.items()):
        lines.append((unit.slot, unit.piece, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + have[unit].rows
    lookup = rows.sparkSession.createDataFrame(lines, "slot int, piece int, shard int, first long")
    rows = _pieces(rows, {u.slot: u.pieces for u in slot_map if u.pieces > 1})
    order = Window.partitionBy("slot", "piece").orderBy("id", "row")
    rows = rows.withColumn("within", F.row_number().over(order)).join(F.broadcast(lookup), ["slot", "piece"])
    return rows.withColumn("place", F.col("first") + F.col("within") - 1).drop("first", "within")


def create(spark: SparkSession, shards: int, slots: int = SLOTS, path: str | None = None) -> str:
    """Store version 1, even runs of slots, and return the folder (a new one in the shared folder where none is named)."""
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    save(spark, path, 1, first_map(slots, shards))
    return path


def sharded(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``slot``, ``piece``, ``shard``, ``place``, ``row`` and the columns of ``carry`` for every record.

    The newest map under ``path`` is edited by the bytes counted in its slots and stored as the next version, which then
    places the records.

    Null and repeated ids are fine: each row is a record.  A null text counts as empty.  Rows alike in all columns are
    records of their own.  An empty table gives an empty result, and a map as it was.  Columns other than those named
    take no part.  A single record larger than a shard's share makes that shard larger; nothing is cut.
    """
    spark = docs.sparkSession
    version, old = load(spark, path)
    rows = records(docs, 1 + max(u.slot for u in old), id_col, text_col, carry)
    have = weights(rows, 1 + max(u.slot for u in old), shards)
    save(spark, path, version + 1, rebalanced(split(old, have), have, shards))
    return placed(rows, load(spark, path)[1], have)
