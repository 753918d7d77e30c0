"""MinHash near-duplicate groups by a multi-index Hamming join.

A signature has ``CHUNKS * WIDTH`` positions of 16 bits.  Two signatures at a distance (number of
positions that differ) of at most ``2 * CHUNKS - 1`` have, by the pigeonhole principle, a chunk with
at most one wrong position.  Each chunk is therefore indexed under every choice of one position left
out, and all pairs up to that distance, which is ``MAX_DISTANCE``, meet in some bucket.  Pairs that meet
are confirmed on their full shingle sets.

At Jaccard 0.75 a position differs with probability 0.25, so a pair is within the distance with
probability 1 - 2e-5.

Buckets are never expanded into all their pairs.  (1) each member meets its bucket's leader;
(2) members not connected by that meet the nearest of other leaders; (3) what is still apart is
compared on signatures: members outside the leader's component with all, a large bucket in parts that meet once, and only
pairs of different components that are near enough leave the task.  Links inside a component would not change it, so none that matters is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.shared import small_batches, unused, written
from fabula.llm.wordhash import Words, mix, shingle_sets, slices

SHINGLE_WORDS = 5
CHUNKS, WIDTH = 16, 4
POSITIONS = CHUNKS * WIDTH
#: What the index guarantees.  Mean 16 and deviation 3.5 at Jaccard 0.75: over four deviations above.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Bits of the second signature, made only for documents of buckets that stay open.  At Jaccard 0.75
#: 256 of them differ, with a deviation of 15: again 4.5 deviations.
FINE_BITS, MAX_FINE = 2048, 323
#: Members of a part of a bucket; two parts meet in a group of their own (384 bytes a member).
BLOCK = 4096

_A = np.random.default_rng(75).integers(0, 2**31, POSITIONS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(57).integers(0, 2**32, POSITIONS, dtype=np.int64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(best, (low[at : at + 4096, None] * _A + _B).min(axis=0), out=best)
    return (mix(best.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


_FINE_A = np.random.default_rng(751).integers(0, 2**31, FINE_BITS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_B = np.random.default_rng(571).integers(0, 2**32, FINE_BITS, dtype=np.int64).astype(np.uint32)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of ``FINE_BITS`` minima, packed in 64-bit words."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(FINE_BITS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 16):
        np.minimum(best, (low[at : at + 16, None] * _FINE_A + _FINE_B).min(axis=0), out=best)
    return np.packbits((best * np.uint32(0x9E3779B1)) >> np.uint32(31)).view(np.uint64)


def _set_key(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def _signed(batches):
    for batch in batches:
        keys, counts, sigs = [], [], []
        for _, data, offsets in slices(batch.column("text")):
            for _, own in shingle_sets(Words(data, offsets, lower=True), SHINGLE_WORDS):
                keys.append(_set_key(own) if len(own) else None)
                counts.append(len(own))
                sigs.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())],
            ["doc_id", "text_key", "node", "n_shingles", "sig"],
        )


def _fine(batches):
    for batch in batches:
        keys, fine = [], []
        for _, data, offsets in slices(batch.column("text")):
            for _, own in shingle_sets(Words(data, offsets, lower=True), SHINGLE_WORDS):
                if len(own):
                    keys.append(_set_key(own))
                    fine.append(fine_signature(own).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fine, pa.binary())], ["node", "fine"])


def _shingled(batches):
    """A batch for each slice: sets are larger than their texts."""
    for batch in batches:
        for _, data, offsets in slices(batch.column("text")):
            keys, sets = [], []
            for _, own in shingle_sets(Words(data, offsets, lower=True), SHINGLE_WORDS):
                keys.append(_set_key(own) if len(own) else None)
                sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS, WIDTH) bucket keys of signatures: key [c, p] is of chunk c without its position p."""
    parts = sigs.reshape(len(sigs), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty(parts.shape, dtype=np.uint64)
    chunk = np.arange(CHUNKS, dtype=np.uint64)[None, :]
    for p in range(WIDTH):
        key = np.zeros(parts.shape[:2], dtype=np.uint64)
        for k in range(WIDTH):
            if k != p:
                key = (key << np.uint64(16)) | parts[:, :, k]
        out[:, :, p] = mix(key ^ mix(chunk * np.uint64(WIDTH) + np.uint64(p + 1)))
    return out


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), POSITIONS)


def _bucketed(batches):
    for batch in batches:
        n = len(batch)
        if n:
            keys = chunk_keys(_sigs(batch.column("sig"))).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.reshape(-1).view(np.int64)),
                    pa.array(np.tile(np.arange(POSITIONS, dtype=np.int8), n)),
                    pa.array(np.repeat(batch.column("node").to_numpy(), POSITIONS)),
                    pa.array(np.repeat(batch.column("n").to_numpy(), POSITIONS)),
                ],
                ["bucket", "slot", "node", "n"],
            )


def _distances(batches):
    for batch in batches:
        if len(batch):
            far = (_sigs(batch.column("sig_a")) != _sigs(batch.column("sig_b"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far.astype(np.int32))], ["a", "b", "distance"])


def _parted(open_: DataFrame) -> DataFrame:
    """Rows of open buckets (bucket, slot, node, n, comp, outlier, size) in the groups (p, q) in which they are compared: outliers, in
    parts, meet each part of the others once, and each other; the others do not meet among themselves."""
    count = open_.groupBy("bucket", "slot").agg(F.count_if("outlier").alias("outliers"))
    parts_of = lambda n: F.ceil(n / BLOCK).cast("int")
    own, rest = parts_of(F.col("outliers")), parts_of(F.col("size") - F.col("outliers"))
    place = F.pmod(F.xxhash64("node"), F.when(F.col("outlier"), own).otherwise(rest)).cast("int")
    group = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    other = lambda j: group(F.least("part", j), -1 - F.greatest(F.col("part"), j))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    later = F.transform(F.filter(upto(own), lambda j: j != F.col("part")), other)
    groups = F.when(F.col("outlier"), F.concat(F.transform(upto(rest), lambda k: group(F.col("part"), k)), later)).otherwise(F.transform(upto(own), lambda i: group(i, F.col("part"))))
    open_ = open_.join(count, ["bucket", "slot"]).withColumn("part", place).withColumn("g", F.explode(groups))
    return open_.select("bucket", "slot", "g.p", "g.q", "part", "node", "n", "comp", "outlier")


def _apart(key, rows, size_ratio: float):
    """Pairs of one bucket that lie in different components, one of them an outlier, each pair from the first slot only in
    which it meets.  ``key`` ends with a part of the outliers and, from 0, a part of the others (with the first the outliers
    also meet each other), or -1 less a later part of the outliers."""
    import pandas as pd

    slot = int(rows["slot"].iloc[0])
    node, comp, size, part = (rows[c].to_numpy() for c in ("node", "comp", "n", "part"))
    sigs = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint16).reshape(len(rows), POSITIONS)
    fine = np.frombuffer(b"".join(rows["fine"]), dtype=np.uint64).reshape(len(rows), FINE_BITS // 64)
    is_outlier, chunk, pos, other = rows["outlier"].to_numpy(), slot // WIDTH, slot % WIDTH, int(key[3])
    left, right = [], []
    for at in np.flatnonzero(is_outlier):
        ok = (comp != comp[at]) & (np.minimum(size, size[at]) >= size_ratio * np.maximum(size, size[at])) & ~(is_outlier & (node < node[at]))
        if other:
            ok &= ~is_outlier if other > 0 else part != part[at]
        found = np.flatnonzero(ok)
        differs = sigs[found] != sigs[at]
        close = np.count_nonzero(differs, axis=1) <= MAX_DISTANCE
        found = found[close]
        met = differs[close].reshape(len(found), CHUNKS, WIDTH).sum(axis=2)
        found = found[~(met[:, :chunk] <= 1).any(axis=1) & ((met[:, chunk] == 1) | (pos == 0))]
        found = found[np.bitwise_count(fine[found] ^ fine[at]).sum(axis=1, dtype=np.int64) <= MAX_FINE]
        left.append(np.full(len(found), node[at]))
        right.append(node[found])
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b): the smallest node reachable.  Labels spread along
    the links and then jump to the label of their label, so the rounds grow with the logarithm of the
    longest chain.  Every round is written to the shared folder; nothing but a count reaches the driver."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("best"))
        spread = labels.join(heard, labels.node == heard.a).select("node", F.col("comp").alias("was"), F.least("comp", "best").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = written(spread.join(up, "near").select("node", "was", F.least("near", "far").alias("comp")), "labels")
        moved = not new.filter("was <> comp").limit(1).isEmpty()
        labels = new.select("node", "comp")
        if not moved:
            return labels


def _texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ids stand for a node of ``wanted``; a text of another node may be among them."""
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("rep_id").alias("doc_id"))
    return docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union of their full sets; all, with ``linked``.
    Only texts that stand for a node of a pair are shingled again."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _texts(wanted, docs, nodes).mapInArrow(_shingled, "node long, shingles array<long>").filter("node is not null")
    sets = written(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.select("a", "b").join(two, "b").join(one, "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.select("a", "b", (100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).alias("linked"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of 5-word shingles (A-Z lower-cased) have a Jaccard index of ``percent`` / 100 or more.

    Returns a row for each row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by
    confirmed links, its own included), kept (doc_id = component_id).  Null or empty texts and texts
    without words have no shingles and stand alone.  Rows with equal sets are one node, so copies of any
    number cost one signature; their rows share a component.  A null id is never the smallest and never
    kept unless nothing else is in its group; of rows that repeat the kept id all are kept.  An empty
    table gives an empty result.  Other columns are not carried, so their names cannot clash.
    """
    return _grouped(docs, percent, id_col, text_col).drop("text_key")


def deduplicated(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, all its columns as they were; of rows that repeat its id and text, one."""
    key, ident, of, nth = unused(docs.columns, "key", "id", "of", "nth")
    kept = _grouped(docs, percent, id_col, text_col).filter("kept").select(F.col("doc_id").alias(ident), F.col("text_key").alias(of)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    met = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(of)))
    once = Window.partitionBy(ident, key).orderBy(ident)
    return met.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    with small_batches(docs.sparkSession):  # all that runs in Python is written before the result is returned
        return _groups(docs, percent, id_col, text_col)


def _groups(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signed, "doc_id long, text_key long, node long, n_shingles long, sig binary")
    rows = written(signed, "signatures")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep_id"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")
    )
    nodes = written(nodes, "nodes")
    ratio = percent / 100

    # Members of buckets that hold more than one node, and each bucket's leader: the smallest node, itself a hash.
    # Leaders come from an aggregate, so that no bucket, however large, is gathered in one task.
    slots = written(nodes.select("node", "n", "sig").mapInArrow(_bucketed, "bucket long, slot byte, node long, n long"), "slots")
    shared = slots.groupBy("bucket", "slot").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").drop("last")
    members = written(slots.join(shared, ["bucket", "slot"]), "members")

    def near(pairs: DataFrame) -> DataFrame:
        """Add the signature distance to ``pairs`` (a, b) and keep the near ones whose sizes allow a link."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
        two = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= ratio * F.greatest("n_a", "n_b"))
        return two.mapInArrow(_distances, "a long, b long, distance int").filter(F.col("distance") <= MAX_DISTANCE)

    def couples(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    first = near(couples(members.filter("node <> leader"), "node", "leader"))
    tried = written(_confirmed(written(first, "near"), docs, nodes, percent), "tried")
    links = tried.filter("linked").select("a", "b")

    def placed(links: DataFrame) -> DataFrame:
        """Members of buckets that are not within one component, beside another leader: the first in an order of the bucket's own."""
        comp = components(links)
        own = members.drop("leader").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        order = F.struct(F.xxhash64("bucket", "node").alias("h"), "node", "comp")
        open_ = own.groupBy("bucket", "slot").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"), F.min(order).alias("leader"))
        return own.join(open_.filter("low <> high and size > 2").select("bucket", "slot", "size", "leader"), ["bucket", "slot"])

    # Those not yet in the component of that leader meet it: the nearest few of such pairs.
    other = placed(links).filter("comp <> leader.comp").withColumn("leader", F.col("leader.node"))
    second = near(couples(other, "node", "leader").join(tried, ["a", "b"], "left_anti"))
    sides = second.select("*", F.explode(F.array("a", "b")).alias("side"))
    nearest = Window.partitionBy("side").orderBy("distance", "a", "b")
    second = couples(sides.withColumn("r", F.row_number().over(nearest)).filter("r <= 4"), "a", "b")
    tried = written(tried.union(_confirmed(written(second, "near"), docs, nodes, percent)), "tried")
    links = tried.filter("linked").select("a", "b")

    # All pairs of different components that are near enough and were not tried.
    open_ = written(placed(links).withColumn("outlier", F.col("comp") != F.col("leader.comp")).drop("leader"), "open")
    asked = open_.select("node").distinct()
    fine = _texts(asked, docs, nodes).mapInArrow(_fine, "node long, fine binary").join(asked, "node", "left_semi").dropDuplicates(["node"])
    fine = written(fine.join(nodes.select("node", "sig"), "node"), "fine")
    open_ = _parted(open_).join(fine, "node")
    third = open_.groupBy("bucket", "slot", "p", "q").applyInPandas(lambda key, rows: _apart(key, rows, ratio), "a long, b long")
    third = third.distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(_confirmed(written(third, "near"), docs, nodes, percent).filter("linked").select("a", "b"))

    comp = components(links)
    group = nodes.join(comp, "node", "left").select("node", "rep_id", F.coalesce("comp", "node").alias("comp"))
    smallest = group.groupBy("comp").agg(F.min("rep_id").alias("component_id"))
    group = group.join(smallest, "comp").select(F.col("node").alias("of"), "component_id")
    out = rows.join(group, rows.node == group.of, "left")
    ident = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", ident.alias("component_id"), F.col("doc_id").eqNullSafe(ident).alias("kept"))
