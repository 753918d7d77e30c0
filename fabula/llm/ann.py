"""Approximate nearest neighbours by inner product from balanced posting lists.

Centroids come from k-means on a bounded sample.  A two-level graph over them, small enough for every
task, finds those near a vector.  A vector is posted to its nearest centroid and, at a boundary, to others
that are nearly as near.  Lists that lie together in the graph share a block of bounded size; a list too
long for one is dealt over several, so blocks are balanced however the vectors lie.  A query visits the
blocks of every list whose distance is within a ratio of the nearest one's.  The ratio is measured: a
bounded number of queries is compared with all rows, and the ratio is the smallest that reaches
``TARGET`` of their true neighbours.  Each query meets its nearest few blocks first; the others then give
only vectors that are no worse than the last of the best found so far.

Any finite vector may come.  Lists are found with vectors divided by ``most``, twice the norm that all but a
thousandth stay under.  The few that are longer still would make all others look alike, so they have a list of their own, which every
query visits.  Products are compared with queries divided by the sum of their components, so that none overflows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.shared import written

#: Vectors of which centroids are learned, the first by a hash of id and vector.
SAMPLE = 20_000
#: Vectors of a list on average, and the most lists, so that the graph (8 bytes for each of a centroid's numbers) is broadcast.
PER_LIST, MAX_LISTS = 100, 8192
#: A vector is posted where its distance is under so many times the nearest one's, to so many lists at most.
POST_RATIO, POSTINGS = 1.05, 4
#: Queries that set the ratio of visited lists, and the share of their true neighbours that it must reach.
CALIBRATION, TARGET = 128, 0.97
#: Numbers in the vectors of a block, queries that meet one block in one task, and queries compared with it at once.
BLOCK_NUMBERS, QUERY_SHARE, QUERY_SLICE = 1 << 19, 8192, 1024
#: Blocks that a query meets first.
FIRST = 4
#: Vectors over ``LONG`` times the norm that this share stays under are met by every query.
SHARE, LONG = 0.999, 2.0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def kmeans(sample: np.ndarray, k: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """Centroids of ``sample``; an empty cluster restarts at the vector furthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = np.concatenate([_sq_distances(part, c).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            far = ((sample - c[near]) ** 2).sum(1).argsort()[::-1][: len(empty)]
            c[empty[: len(far)]] = sample[far]
    return c


class Graph:
    """Centroids in a graph of two levels: each hangs from the nearest of about sqrt(n) hubs, which knows
    how far the furthest of its own reaches."""

    def __init__(self, centroids: np.ndarray):
        hubs = kmeans(centroids, max(1, round(len(centroids) ** 0.5)), rounds=6)
        near = _sq_distances(centroids, hubs).argmin(1)
        used = np.unique(near)
        self.centroids, self.hubs = centroids, hubs[used]
        self.members = [np.flatnonzero(near == h) for h in used]
        self.reach = np.array([np.sqrt(_sq_distances(centroids[m], hubs[[h]]).max()) for h, m in zip(used, self.members, strict=True)])

    def distances(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """(rows of ``x``, centroids): the distance wherever it is within ``ratio`` of the row's nearest
        centroid, else the distance or infinity.

        Every row opens its nearest hub, and then those whose centroids may still be near enough by the
        triangle inequality.  All rows that open a hub are measured in one product."""
        to_hub = np.sqrt(_sq_distances(x, self.hubs))
        out = np.full((len(x), len(self.centroids)), np.inf)

        def opened(mask):
            for h, own in enumerate(self.members):
                rows = np.flatnonzero(mask[:, h])
                if len(rows):
                    out[np.ix_(rows, own)] = np.sqrt(_sq_distances(x[rows], self.centroids[own]))

        first = np.zeros(to_hub.shape, dtype=bool)
        first[np.arange(len(x)), to_hub.argmin(1)] = True
        opened(first)
        opened((to_hub - self.reach <= ratio * out.min(1)[:, None] + 1e-9) & ~first)
        return out

    def posts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the lists of each row of ``x``."""
        dist = self.distances(x, POST_RATIO)
        n = min(POSTINGS, dist.shape[1])
        near = np.argpartition(dist, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(dist, near, 1)
        row, at = np.nonzero(value <= value.min(1)[:, None] * POST_RATIO + 1e-12)
        return row, near[row, at]


def _norms(x: np.ndarray) -> np.ndarray:
    """Of rows that are not zero; their squares may be beyond a double's range, their norms rarely are."""
    top = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors over ``most`` with one more coordinate, so that all have the norm 1: the nearest then has the largest inner product."""
    x = x / most
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], axis=1)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter("vec_id is not null and v is not null and size(v) > 0").filter(~bad).filter(F.exists("v", lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _asking(x: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors: of their norm, so that the ratio does not depend on a query's length."""
    return np.concatenate([_unit(x), np.zeros((len(x), 1))], axis=1)


def _weighing(q: np.ndarray) -> np.ndarray:
    """Queries divided by the sum of their components: a product with any vector is no larger than that vector's components,
    and orders vectors as the query's own does."""
    q = q / np.abs(q).max(axis=1)[:, None]
    return q / np.abs(q).sum(1)[:, None]


def nearest_of_all(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """(q, vec_id, score, v): the true ``k`` nearest of ``rows`` (vec_id, v) for each of a few queries, by comparison with all rows."""

    weighing = _weighing(q)

    def best(batches):
        top = np.full((len(q), k), -np.inf)
        who, what = np.zeros((len(q), k), dtype=np.int64), np.zeros((len(q), k, q.shape[1]))
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                own, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), q.shape[1])
                score = weighing @ x.T
                score[ids[:, None] == own[None, :]] = -np.inf
                both = np.concatenate([top, score], axis=1)
                pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
                old = pick < k
                new = np.where(old, 0, pick - k)
                who = np.where(old, np.take_along_axis(who, np.where(old, pick, 0), 1), own[new])
                what = np.where(old[:, :, None], np.take_along_axis(what, np.where(old, pick, 0)[:, :, None], 1), x[new])
                top = np.take_along_axis(both, pick, 1)
        r, c = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays(
            [pa.array(r.astype(np.int32)), pa.array(who[r, c]), pa.array(top[r, c]), pa.array(list(what[r, c]), pa.list_(pa.float64()))], ["q", "vec_id", "score", "v"]
        )

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = rows.select("vec_id", "v").mapInArrow(best, "q int, vec_id long, score double, v array<double>").dropDuplicates(["q", "vec_id"])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank").toArrow()  # k rows for each query


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries`` (the same
    columns): query_id, rank (from 1), vec_id, score.  A query's own id is no candidate of its own.

    Scores are exact, in double precision; ties go to the smaller id.  A score beyond the range of a double is infinite; such
    are ordered by what they would be.  Vectors that are null, zero, or
    hold a null or non-finite component take no part, nor do null ids or vectors whose width is not the
    most common one.  Rows that repeat id and vector count once; so does an id with several vectors, by
    its best.  With fewer than ``k`` candidates in all, all are found.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    # The largest component first, and the norm from what that leaves of the others.
    norm = F.transform(F.array(F.array_max(F.transform("v", F.abs))), lambda top: top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))))[0]
    rows = written(rows.select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("vec_id", "v").alias("h"), norm.alias("norm")), "vectors")
    widths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    width, total = widths["d"], widths["n"]
    rows = rows.filter(F.col("d") == width).select("vec_id", "v", "h", "norm")
    asked = valid(queries, id_col, vector_col).filter(F.size("v") == width).dropDuplicates()
    longest, common = rows.agg(F.max("norm"), F.percentile_approx("norm", SHARE, 10_000)).first()
    most = min(longest, LONG * common)
    sample = _matrix(rows.filter(F.col("norm") <= most).orderBy("h", "vec_id").limit(SAMPLE).select("v").toArrow().column("v"), width)  # at most SAMPLE rows
    lists = int(max(1, min(MAX_LISTS, total // PER_LIST, len(sample) // 4)))
    graph = Graph(kmeans(_lifted(sample, most), lists))
    # Vectors longer than ``most`` are the last list.
    shared = spark.sparkContext.broadcast(graph)

    def posted(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column("v"), width)
                long = _norms(x) > most
                (short,) = np.nonzero(~long)
                row, near = shared.value.posts(_lifted(x[short], most)) if len(short) else (short, short)
                row, near = np.concatenate([short[row], np.flatnonzero(long)]), np.concatenate([near, np.full(long.sum(), lists)])
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), own.column("vec_id"), own.column("h"), own.column("v")], ["list", "vec_id", "h", "v"])

    postings = written(rows.drop("norm").mapInArrow(posted, "list int, vec_id long, h long, v array<double>"), "postings")
    held = np.zeros(lists + 1, dtype=np.int64)
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MAX_LISTS rows and one
        held[r["list"]] = r["n"]

    # Blocks: lists hub by hub, so that those near one another lie together; a long list has blocks of its own.
    size = max(64, BLOCK_NUMBERS // width)
    parts, base = np.maximum(1, -(-held // size)), np.zeros(lists + 1, dtype=np.int64)
    blocks, room = 0, 0
    for c in [*np.concatenate(graph.members).tolist(), lists]:
        if parts[c] > 1 or held[c] > room:
            base[c], blocks = blocks, blocks + int(parts[c])
            room = 0 if parts[c] > 1 else size - held[c]
        else:
            base[c], room = blocks - 1, room - held[c]

    first = asked.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(CALIBRATION).toArrow()  # at most CALIBRATION rows
    ratio = 1.0
    if len(first):
        q = _matrix(first.column("v"), width)
        true = nearest_of_all(rows, first.column("vec_id").to_numpy(), q, k)
        dist = graph.distances(_asking(q), np.inf)
        x, at = _matrix(true.column("v"), width), true.column("q").to_numpy()
        short = np.flatnonzero(_norms(x) <= most)  # the others are met anyway
        need = np.where(_norms(x) <= most, np.inf, 0.0)
        if len(short):
            row, near = graph.posts(_lifted(x[short], most))
            row = short[row]
            np.minimum.at(need, row, dist[at[row], near] / np.maximum(dist[at[row]].min(1), 1e-12))
        ratio = max(1.0, float(np.quantile(need, TARGET, method="higher"))) * (1 + 1e-9) if len(need) else 1.0

    def probed(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                q = _asking(_matrix(batch.column("v"), width))
                dist = shared.value.distances(q, ratio)
                visited = dist <= dist.min(1)[:, None] * ratio + 1e-12
                # Lists must hold enough vectors, whatever the ratio: each is posted POSTINGS times at most.
                for r in np.flatnonzero((visited * held[:-1]).sum(1) < POSTINGS * (k + 1)):
                    own = np.sqrt(_sq_distances(q[[r]], shared.value.centroids))[0].argsort()
                    visited[r, own[: np.searchsorted(np.cumsum(held[own]), POSTINGS * (k + 1)) + 1]] = True
                dist, visited = np.pad(dist, ((0, 0), (0, 1))), np.pad(visited, ((0, 0), (0, 1)), constant_values=held[-1] > 0)
                row, near = np.nonzero(visited)
                block = np.repeat(base[near], parts[near]) + np.concatenate([np.arange(p) for p in parts[near]])
                row, far = np.repeat(row, parts[near]), np.repeat(dist[row, near], parts[near])
                # Each block once, at the distance of its nearest list; then a row's blocks by distance.
                order = np.lexsort((far, block, row))
                row, block, far = row[order], block[order], far[order]
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                order = np.lexsort((block[once], far[once], row[once]))
                row, block = row[once][order], block[once][order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < FIRST
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), pa.array(block), pa.array(first)], ["query_id", "q", "block", "first"])

    probes = written(asked.mapInArrow(probed, "query_id long, q array<double>, block long, first boolean"), "probes")
    place = F.broadcast(spark.createDataFrame([(c, int(b), int(p)) for c, (b, p) in enumerate(zip(base, parts, strict=True))], "list int, base long, parts int"))
    placed = postings.join(place, "list").select((F.col("base") + F.pmod("h", "parts")).alias("block"), "vec_id", "h", "v")
    nothing = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "weighed": np.zeros(0)}

    def compared(_, left, right):
        import pandas as pd

        out = [pd.DataFrame(nothing)]
        if len(left) and len(right):
            right = right.drop_duplicates(["vec_id", "h"])
            ids, x = right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy())
            wide = min(len(ids), k * int(np.unique(ids, return_counts=True)[1].max()))  # an id with several vectors takes one place in the end
            for at in range(0, len(left), QUERY_SLICE):
                part = left.iloc[at : at + QUERY_SLICE]
                q, who, least = np.stack(part["q"].to_numpy()), part["query_id"].to_numpy(), part["least"].to_numpy()
                weighing = _weighing(q)
                rough = weighing @ x.T
                rough[who[:, None] == ids[None, :]] = -np.inf
                cut = np.maximum(np.partition(rough, -wide, axis=1)[:, -wide], least)
                # Products of one vector may differ in the last bits by its place, so near ties are measured again, alike.
                r, c = np.nonzero((rough >= (cut - 1e-9 * np.abs(cut) - 1e-300)[:, None]) & np.isfinite(rough))
                weighed = (weighing[r] * x[c]).sum(axis=1)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (q[r] * x[c]).sum(axis=1)
                    score = np.where(np.isfinite(score), score, np.copysign(np.inf, weighed))
                order = np.lexsort((ids[c], np.where(np.isfinite(score), 0, -weighed), -score, r))
                r, c, score, weighed = r[order], c[order], score[order], weighed[order]
                start = np.searchsorted(r, np.arange(len(q)))
                keep = np.arange(len(r)) - start[r] < wide
                out.append(pd.DataFrame({"query_id": who[r[keep]], "vec_id": ids[c[keep]], "score": score[keep], "weighed": weighed[keep]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    def met(probes: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, weighed) of the vectors that blocks give for ``probes`` (query_id, q, block, least)."""
        # A block that very many queries visit meets them in shares.
        shares = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_SHARE).cast("int").alias("shares")).filter("shares > 1")
        share = F.coalesce("shares", F.lit(1))
        left = probes.join(shares, "block", "left").withColumn("share", F.pmod(F.xxhash64("query_id", "q"), share).cast("int")).drop("shares")
        right = placed.join(shares, "block", "left").withColumn("share", F.explode(F.sequence(F.lit(0), share - 1))).drop("shares")
        return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInPandas(compared, "query_id long, vec_id long, score double, weighed double")

    def ranked(found: DataFrame) -> DataFrame:
        best = F.max(F.struct("score", "weighed")).alias("best")
        found = found.groupBy("query_id", "vec_id").agg(best).select("query_id", "vec_id", "best.*")
        beyond = F.when(F.abs("score") == float("inf"), F.col("weighed"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(beyond), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = written(ranked(met(probes.filter("first").select("query_id", "q", "block", F.lit(float("-inf")).alias("least")))), "near")
    last = near.filter(F.col("rank") == k).select("query_id", F.col("weighed").alias("last"))
    rest = probes.filter("not first").join(last, "query_id", "left").select("query_id", "q", "block", F.coalesce("last", F.lit(float("-inf"))).alias("least"))
    found = ranked(near.select("query_id", "vec_id", "score", "weighed").unionByName(met(rest))).select("query_id", "rank", "vec_id", "score")
    found = written(found, "found")
    _guarded(found, asked, rows, k)
    return found


def _guarded(found: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> None:
    """An error if a query has fewer than ``k`` rows while there are candidates left."""
    ids = asked.select("vec_id").distinct().join(rows.select("vec_id", F.lit(1).alias("own")).distinct(), "vec_id", "left")
    total = rows.select("vec_id").distinct().count()
    want = F.least(F.lit(k).cast("long"), F.lit(total) - F.coalesce("own", F.lit(0)))
    have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    short = ids.join(have, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < want).count()
    if short:
        raise RuntimeError(f"{short} queries have fewer neighbours than there are candidates")
