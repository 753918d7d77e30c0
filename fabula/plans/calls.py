"""Calls of services outside Spark from inside its tasks: bounded, replayable and checked before the job starts.

An engine is a picklable function with replicas that it may be sent to.  Requests are rows.  They are dealt out so that each
replica is served by exactly one task, in which no more calls than it takes are ever in flight; a request waits
for the next free replica of its task.  Only what concerns the transport is tried again, after a pause that grows; a mistake
of the engine or of the request ends the job with its own message.  A task that is run again asks again: engines must
bear that, as they must for any caller that retries.
"""

from __future__ import annotations

import queue
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may go away by itself: refused, reset or broken connections and time running out.
TRANSPORT = (ConnectionError, TimeoutError)
#: Faulty requests that an error names.
NAMED = 20


class EngineError(ValueError):
    """Requests that no engine can serve."""


@dataclass(frozen=True)
class Engine:
    """``call`` (replica, prompt) gives the reply.  ``features`` is what the engine can do; a replica takes ``in_flight`` calls at once."""

    name: str
    call: Callable[[str, str], str]
    replicas: tuple[str, ...] = ("",)
    features: frozenset[str] = frozenset()
    in_flight: int = 1


class Engines:
    """Engines by name, and the one that serves requests for a name that is not among them."""

    def __init__(self, engines: list[Engine], default: str | None = None):
        self.by_name = {e.name: e for e in engines}
        if len(self.by_name) < len(engines) or not all(e.replicas and e.in_flight > 0 for e in engines):
            raise EngineError("engines need names of their own, replicas, and room for a call")
        if default is not None and default not in self.by_name:
            raise EngineError(f"the default engine {default} is not registered")
        self.default = default

    def routed(self, requests: DataFrame) -> DataFrame:
        """Add ``routed`` to ``requests`` (engine): the engine's own name if registered (blanks around it aside), else the default, else null."""
        name = F.trim(F.coalesce("engine", F.lit("")))
        return requests.withColumn("routed", F.when(name.isin(list(self.by_name)), name).otherwise(F.lit(self.default)))

    def checked(self, requests: DataFrame) -> DataFrame:
        """``routed``, or an error that names some of the requests that no engine can serve: unknown names without a default,
        and engines without a feature of ``needs`` (array of strings, if there is such a column)."""
        rows = self.routed(requests)
        if "needs" in requests.columns:
            can = F.array().cast("array<string>")
            for e in self.by_name.values():
                can = F.when(F.col("routed") == e.name, F.array(*[F.lit(f) for f in sorted(e.features)]).cast("array<string>")).otherwise(can)
            lacks = F.array_except(F.coalesce("needs", F.array().cast("array<string>")), can)
        else:
            lacks = F.array().cast("array<string>")
        bad = rows.select("engine", "routed", F.array_join(F.array_sort(lacks), ", ").alias("lacks")).filter("routed is null or lacks <> ''")
        found = bad.distinct().limit(NAMED).collect()
        if found:
            raise EngineError("; ".join(sorted(f"no engine {r.engine}" if r.routed is None else f"{r.routed} lacks {r.lacks}" for r in found)))
        return rows


class _Pool:
    """The replicas of an engine that one task serves, each as often as it takes calls."""

    def __init__(self, engine: Engine, replicas: tuple[str, ...], attempts: int, pause_s: float):
        self.engine, self.attempts, self.pause_s = engine, attempts, pause_s
        self.free: queue.Queue[str] = queue.Queue()
        for replica in [r for _ in range(engine.in_flight) for r in replicas]:
            self.free.put(replica)
        self.size = self.free.qsize()
        self.threads = ThreadPoolExecutor(self.size)

    def ask(self, prompt: str) -> tuple[str | None, int, str | None]:
        """Reply, number of calls, and the last transport error where none got through."""
        said = None
        for attempt in range(1, self.attempts + 1):
            replica = self.free.get()
            try:
                return self.engine.call(replica, prompt), attempt, None
            except TRANSPORT as e:
                said = f"{type(e).__name__}: {e}"
            finally:
                self.free.put(replica)
            if attempt < self.attempts:
                time.sleep(self.pause_s * attempt)
        return None, self.attempts, said


def _kept_busy(rows: list, submit: Callable, ahead: int) -> Iterator:
    """Results in order, with ``ahead`` calls handed on at most."""
    waiting: deque[Future] = deque()
    try:
        for row in rows:
            if len(waiting) >= ahead:
                yield waiting.popleft().result()
            waiting.append(submit(row))
        while waiting:
            yield waiting.popleft().result()
    finally:
        for f in waiting:
            f.cancel()


def called(requests: DataFrame, engines: Engines, attempts: int = 3, pause_s: float = 1.0, lanes: int = 64) -> DataFrame:
    """Add ``routed``, ``reply``, ``calls`` and ``error`` to ``requests`` (engine, prompt): the reply is null where no attempt got through, and
    ``error`` says why.  Requests without a prompt are not asked.

    An engine's replicas are dealt to as many tasks as it has replicas (``lanes`` at most), and requests to those by a hash of the prompt
    and a number of their own, so that requests alike spread as well."""
    rows = engines.checked(requests)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", reply string, calls int, error string"
    width = F.lit(1)
    for e in engines.by_name.values():
        width = F.when(F.col("routed") == e.name, F.lit(min(lanes, len(e.replicas)))).otherwise(width)
    dealt = rows.withColumn("_lane", F.pmod(F.xxhash64("prompt", F.monotonically_increasing_id()), width).cast("int"))
    tasks = sum(min(lanes, len(e.replicas)) for e in engines.by_name.values())
    by_name, columns = engines.by_name, rows.columns

    def run(batches):
        pools: dict[tuple[str, int], _Pool] = {}

        def pool(name: str, lane: int) -> _Pool:
            if (name, lane) not in pools:
                engine = by_name[name]
                pools[name, lane] = _Pool(engine, engine.replicas[lane :: min(lanes, len(engine.replicas))], attempts, pause_s)
            return pools[name, lane]

        def submit(row):
            name, lane, prompt = row
            if not isinstance(prompt, str):
                done: Future = Future()
                done.set_result((None, 0, None))
                return done
            own = pool(name, lane)
            return own.threads.submit(own.ask, prompt)

        try:
            for batch in batches:
                asked = list(zip(batch["routed"], batch["_lane"], batch["prompt"], strict=True))
                ahead = 2 * sum(pool(n, k).size for n, k in {(n, k) for n, k, p in asked if isinstance(p, str)}) or 1
                replies = pd.DataFrame(list(_kept_busy(asked, submit, ahead)), columns=["reply", "calls", "error"], index=batch.index, dtype=object)
                yield pd.concat([batch[columns], replies], axis=1)
        finally:
            for p in pools.values():
                p.threads.shutdown(cancel_futures=True)

    return dealt.repartition(max(1, tasks), "routed", "_lane").mapInPandas(run, schema)
