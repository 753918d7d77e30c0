"""Job status, progress and incremental renders as streams with keyed state.

A state for each job (or block of a job's segments) is in Spark's state store: what a batch brings is folded into it, and
nothing that earlier batches brought is read again, so plans and batches stay as large as what arrives.  State and
offsets are committed together: a batch that is run again after a failure starts from the state before it.  The present
state of all keys is a table of the checkpoint (``state_of``).

Events of one job are reduced within each task before they are dealt out by key, so that a job with very many events sends
one row for each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from fabula.sources.tables import Folder, work_dir

__all__ = ["PHASES", "events_stream", "incremental_renders", "job_states", "latest_status_stream", "phases", "phases_stream", "progress_stream", "state_of", "work_dir"]

#: Phases of a job in order; an error ends it wherever it is.
PHASES = ("analyzing", "synthesizing", "verifying", "done")
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


@contextmanager
def _state_store(spark: SparkSession):
    """Streams started within use the state store that keyed processors need; the session's own choice returns after."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def _caught_up(rows: DataFrame, folder: str, sink: Callable, mode: str) -> None:
    """Run the stream until its source is read up."""
    with _state_store(rows.sparkSession):
        sink(rows.writeStream.outputMode(mode)).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def state_of(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame | None:
    """The present state of every key (key, value), of an aggregate or of a processor's variable ``name``, or nothing before the first batch."""
    if not Folder(spark, f"{folder}/offsets/commits").exists("0"):
        return None
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", name) if name else reader).load(f"{folder}/offsets").select("key", "value")


def job_states(events: DataFrame, key: str, order: str, columns: list[str], folder: str, phase: str | None = None) -> DataFrame:
    """Follow ``events`` until they are read up; for every job seen so far: key, order, events, far (place of the furthest phase in
    ``PHASES`` from 1, else 0) and the ``columns`` of its last event (greatest order, ties by the columns).  Events without a key or
    an order take no part.  The state of a job is what Spark's own aggregate keeps: a struct and two numbers."""
    spark = events.sparkSession
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col(phase)) if phase else F.lit(0)
    source = events.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    source = source.select(key, F.struct(order, *columns).alias("last"), F.coalesce(place, F.lit(0)).cast("long").alias("far"))
    rows = source.groupBy(key).agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("events"), F.max("far").alias("far"))
    _caught_up(rows, folder, lambda w: w.format("noop"), "update")
    now = state_of(spark, folder)
    if now is None:
        now = spark.createDataFrame([], rows.schema)
    else:  # an aggregate names what it keeps after its functions, in their order
        kept = StructType([f for f in rows.schema if f.name != key])
        now = now.select(F.col("key")[key].alias(key), F.col("value").cast(kept).alias("value")).select(key, "value.*")
    return now.select(key, F.col("last")[order].alias(order), "events", "far", *[F.col("last")[c].alias(c) for c in columns])


def latest_status_stream(events: DataFrame, key: str, order: str, columns: list[str], folder: str) -> DataFrame:
    """The last event of each key and the number of its events: key, order, events, columns."""
    return job_states(events, key, order, columns, folder).drop("far")


def progress_stream(done: DataFrame, reused: DataFrame, key: str, folder: str) -> DataFrame:
    """Segments finished of each job: those reused (key, n), and one for each event of ``done``."""
    counted = done.select(key, F.lit(0).cast("long").alias("seq"))
    last = job_states(counted, key, "seq", [], folder).select(key, F.col("events").alias("rendered"))
    out = reused.select(key, F.col("n").alias("reused")).join(last, key, "full")
    return out.select(key, (F.coalesce("reused", F.lit(0)) + F.coalesce("rendered", F.lit(0))).cast("long").alias("completed"))


def _phase(far, last):
    return F.when(last == "error", "error").otherwise(F.get(F.array(*[F.lit(p) for p in PHASES]), far.cast("int") - 1))


def phases(events: DataFrame) -> DataFrame:
    """The phase of each job from events (job_id, seq, phase): the furthest one reached, or error if the last event is one."""
    place = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    out = events.groupBy("job_id").agg(F.max(place).alias("far"), F.max_by("phase", "seq").alias("last"))
    return out.select("job_id", _phase(F.col("far"), F.col("last")).alias("phase"))


def phases_stream(events: DataFrame, folder: str) -> DataFrame:
    """``phases`` of a stream: job_id, phase, events."""
    out = job_states(events, "job_id", "seq", ["phase"], folder, phase="phase")
    return out.select("job_id", _phase(F.col("far"), F.col("phase")).alias("phase"), "events")


#: Segments whose state is one value: so many ids in a row, or, of ids that are no whole numbers, a part of a job's by hash.
BLOCK, PARTS = 256, 256
#: Decisions that leave a task at once.
CHUNK = 10_000


def _block(rows: DataFrame) -> Column:
    """The block of a job that a segment is in; those without an id are one of their own."""
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.floor(F.col("id") / BLOCK) if whole else F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(PARTS)))


class Renders(StatefulProcessor):
    """For each segment of a block, the fingerprint last asked for or rendered, and its clip.

    A call for each segment would cost far more than what it decides, so a block's segments are one state."""

    def __init__(self, kind: DataType):
        self.schema = StructType([StructField("ids", ArrayType(kind)), StructField("fingerprints", ArrayType(StringType())), StructField("clips", ArrayType(StringType()))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clips", self.schema)

    def _known(self) -> dict:
        if not self.state.exists():
            return {}
        ids, fingerprints, clips = self.state.get()
        return dict(zip(ids, zip(fingerprints, clips, strict=True), strict=True))

    def _keep(self, known: dict) -> None:
        if known:
            self.state.update((list(known), [f for f, _ in known.values()], [c for _, c in known.values()]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self._known()
        for ident, fingerprint, clip in _plain(initialState, "id", "fingerprint", "clip"):
            known[ident] = (fingerprint, clip)
        self._keep(known)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = Counter()
        for batch in rows:
            asked.update(x for x in _plain(batch, "id", "fingerprint") if x[1] is not None)
        known, out = self._known(), []
        for (ident, fingerprint), times in sorted(asked.items(), key=lambda x: x[0][1]):
            have = known.get(ident, (None, None))
            if fingerprint != have[0]:
                have = known[ident] = (fingerprint, f"new_{key[0]}_{ident}")
                out.append((key[0], ident, fingerprint, "todo", None))
                times -= 1
            while times:
                now = min(times, CHUNK)
                out += [(key[0], ident, fingerprint, "reuse", have[1])] * now
                times -= now
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=DECIDED)
                    out = []
        self._keep(known)
        yield pd.DataFrame(out, columns=DECIDED)

    def close(self) -> None:
        pass


DECIDED = ["job_id", "id", "fingerprint", "action", "clip"]


def _plain(rows: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    """Rows as plain values, with None for what is missing."""
    return zip(*[rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in columns], strict=True)


def incremental_renders(segments: DataFrame, ledger: DataFrame, folder: str) -> DataFrame:
    """Follow a stream of segments (job_id, id, fingerprint): what is unchanged since ``ledger`` (job_id, id, fingerprint, clip) or since it was
    last asked for is reused, all else is to do.  Of several fingerprints for a segment in one batch, each is taken in turn, in
    order.  The ledger fills the state before the first batch and is not read again; rows without a fingerprint take no part.

    Returns the decisions of all batches so far: job_id, id, fingerprint, action, clip."""
    kind = lambda c: segments.schema[c].dataType
    out = StructType([StructField("job_id", kind("job_id")), StructField("id", kind("id"))] + [StructField(c, StringType()) for c in ("fingerprint", "action", "clip")])
    known = ledger.filter("fingerprint is not null").groupBy("job_id", "id").agg(F.max(F.struct("fingerprint", "clip")).alias("l")).select("job_id", "id", "l.*")
    of = lambda df: df.withColumn("block", _block(df)).groupBy("job_id", "block")
    rows = of(segments.select("job_id", "id", "fingerprint"))
    rows = rows.transformWithStateInPandas(Renders(kind("id")), out, "Append", "None", initialState=of(known))
    _caught_up(rows, folder, lambda w: w.format("parquet").option("path", f"{folder}/decisions"), "append")
    return segments.sparkSession.read.schema(out).parquet(f"{folder}/decisions")
