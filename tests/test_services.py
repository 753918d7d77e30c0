"""Bounded calls, engines, versioned loads, run deletion and keyed streams."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from fabula.plans import models
from fabula.plans.calls import Engine, EngineError, Engines, _kept_busy, _Pool, called
from fabula.sources.tables import Folder, work_dir
from fabula.sources.versions import LoadConflict, Refused, VersionedTable, delete_runs
from fabula.streaming import status

# calls


def test_no_more_calls_in_flight_than_replicas_take():
    now, most, lock, per = 0, 0, threading.Lock(), {}

    def call(replica, prompt):
        nonlocal now, most
        with lock:
            now, most = now + 1, max(most, now + 1)
            per[replica] = per.get(replica, 0) + 1
            assert per[replica] <= 2
        time.sleep(0.01)
        with lock:
            now, per[replica] = now - 1, per[replica] - 1
        return prompt + "!"

    pool = _Pool(Engine("e", call, in_flight=2), ("a", "b", "c"), 1, 0.0)
    began = time.time()
    assert list(_kept_busy([str(k) for k in range(60)], lambda p: pool.threads.submit(pool.ask, p), 12)) == [(f"{k}!", 1, None) for k in range(60)]
    assert most == 6 and time.time() - began < 0.4


def test_only_transport_errors_are_tried_again():
    seen = []

    def shaky(replica, prompt):
        seen.append(replica)
        if len(seen) < 3:
            raise TimeoutError("slow")
        return "ok"

    pool = _Pool(Engine("e", shaky), ("a", "b"), 3, 0.0)
    assert pool.ask("x") == ("ok", 3, None) and seen == ["a", "b", "a"]
    seen.clear()
    assert _Pool(Engine("e", shaky), ("a",), 2, 0.0).ask("x") == (None, 2, "TimeoutError: slow")
    with pytest.raises(ZeroDivisionError):
        _Pool(Engine("e", lambda r, p: 1 / 0), ("a",), 3, 0.0).ask("x")


def test_called(spark):
    def wrong(replica, prompt):
        raise KeyError(prompt)

    def say(replica, prompt):
        return f"{replica}:{prompt}"

    engines = Engines([Engine("one", say, ("a", "b", "c"), frozenset({"emotion"})), Engine("two", say, ("z",))], default="two")
    rows = [(k, e, None if k == 7 else f"p{k % 5}", ["emotion"] if e == "one" else None) for k, e in enumerate([" one ", "one", "two", "other", None, ""] * 20)]
    df = spark.createDataFrame(rows, "reply_id int, engine string, prompt string, needs array<string>")
    got = {r.reply_id: r for r in called(df, engines, pause_s=0).collect()}
    for k, e, p, _ in rows:
        r = got[k]
        assert r.routed == ("one" if (e or "").strip() == "one" else "two") and (r.reply, r.calls) == (None, 0) if p is None else r.reply[2:] == p and r.reply[0] in ("abc" if r.routed == "one" else "z")
    assert len(got) == len(rows) and {got[k].reply[0] for k, e, p, _ in rows if p and (e or "").strip() == "one"} == {"a", "b", "c"}
    assert called(df.limit(0), engines).count() == 0
    with pytest.raises(EngineError, match="two lacks emotion"):
        called(df.withColumn("needs", F.array(F.lit("emotion"))), engines)
    with pytest.raises(EngineError, match="no engine other"):
        called(df, Engines(list(engines.by_name.values())))
    with pytest.raises(EngineError):
        Engines([Engine("a", say), Engine("a", say)])
    with pytest.raises(EngineError):
        Engines([Engine("a", say)], default="b")
    with pytest.raises(Exception, match="KeyError"):
        called(df.drop("needs"), Engines([Engine("one", wrong)], default="one"), pause_s=0).collect()


def test_a_clients_mistake_ends_the_job(spark):
    df = spark.createDataFrame([("x",)], "prompt string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        models.asked(df, lambda p: 1 / 0).collect()


# versions


def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), "book int, chapter int, text string", ("book", "chapter"))


def test_loads_in_passes_equal_one(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = lambda *xs: spark.createDataFrame(list(xs), "book int, chapter int, text string, extra int")
    assert t.version() == 0 and t.read().count() == 0
    assert t.load(rows((1, 1, "a", 0), (1, 2, "b", 0), (1, None, "n", 0)), "first") == 1
    assert t.load(rows((1, 2, "B", 0), (1, 2, "BB", 0), (1, None, "N", 0)), "second") == 2
    assert t.load(rows((9, 9, "never", 0)), "second") == 2
    now = {(1, 1, "a"), (1, 2, "B"), (1, 2, "BB"), (1, None, "N")}
    assert {tuple(r) for r in t.read().collect()} == now and {r.text for r in t.read(1).collect()} == {"a", "b", "n"}

    # A load that failed before it was listed: its files are there, and nothing has changed; run again, they are replaced.
    rows((5, 5, "half", 0)).select("book", "chapter", "text").write.parquet(f"{t.path}/loads/third")
    assert {tuple(r) for r in t.read().collect()} == now
    assert t.load(rows((2, 1, "c", 0)), "third") == 3
    assert {tuple(r) for r in t.read().collect()} == now | {(2, 1, "c")}

    with pytest.raises(Refused, match="part of the newest"):
        t.delete(["second"])
    assert t.compacted("all") == 4 and {tuple(r) for r in t.read().collect()} == now | {(2, 1, "c")}
    for bad in (["../first"], ["nothing"], [""], ["first", "all"]):
        with pytest.raises(Refused):
            t.delete(bad)
    with pytest.raises(Refused):
        t.delete()
    assert t.delete(["first"]) == ["first"] and t.delete(confirm="all") == ["second", "third"] and t.delete(confirm="all") == []
    assert t.read().count() == 5
    with pytest.raises(Refused):
        t.load(rows((1, 1, "a", 0)), "a/b")


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(1, 1, "a")], t.schema)
    t.load(rows, "first")
    monkeypatch.setattr(VersionedTable, "version", lambda self: 0)
    with pytest.raises(LoadConflict):
        t.load(rows, "second")
    monkeypatch.undo()
    assert t.version() == 1 and t.loads() == ["first"]


def test_runs_are_deleted_by_name_or_all(spark, tmp_path):
    for run in ("r1", "r2", "r3"):
        os.makedirs(tmp_path / "runs" / run / "deep")
    (tmp_path / "runs" / "note.txt").write_text("x")
    root = str(tmp_path / "runs")
    with pytest.raises(Refused):
        delete_runs(spark, root, ["r1", "../runs"])
    assert sorted(os.listdir(root))[1:] == ["r1", "r2", "r3"]
    assert delete_runs(spark, root, ["r1", "gone"]) == ["r1"]
    with pytest.raises(Refused):
        delete_runs(spark, root)
    assert delete_runs(spark, root, confirm="all") == ["r2", "r3"] and os.path.exists(tmp_path / "runs" / "note.txt")


def test_folders(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "f"))
    assert f.names() == [] and f.put("a", "x") and not f.put("a", "y") and f.names() == ["a"] or f.names() == [".a.crc", "a"]
    assert (tmp_path / "f" / "a").read_text() == "x"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Away:
        conf, sparkContext = spark.conf, type("C", (), {"master": "spark://h:7077", "applicationId": "x"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            work_dir(Away, "x")


# streams


EVENTS = "job_id long, seq long, phase string"


def test_state_is_kept_over_batches_and_restarts(spark, tmp_path):
    where, folder = str(tmp_path / "in"), str(tmp_path / "state")
    stream = lambda: status.events_stream(spark, where, spark.createDataFrame([], EVENTS).schema)
    batches = [
        [(1, 1, "analyzing"), (1, 5, "verifying"), (2, 3, "error")],
        [(1, 4, "synthesizing"), (2, 9, "analyzing"), (None, 1, "done"), (3, None, "done")],
        [(1, 6, "error"), (4, 1, "unheard of")],
        [],
    ]
    rows, kept = [], status.state_of(spark, folder, "job")
    assert kept is None
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(where)
        rows += [r for r in batch if r[0] is not None and r[1] is not None]
        want = {}
        for r in status.phases(spark.createDataFrame(rows, EVENTS)).collect():
            want[r.job_id] = (r.phase, sum(x[0] == r.job_id for x in rows))
        got = status.phases_stream(stream(), folder)
        assert {r.job_id: (r.phase, r.events) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert spark.conf.get(status.STORE, "") != status.ROCKS


def test_renders_do_not_read_earlier_batches(spark, tmp_path):
    where, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id long, id long, fingerprint string"
    ledger = spark.createDataFrame([(1, 1, "a", "c1"), (1, 2, "b", "c2"), (1, 9, None, "c9")], schema + ", clip string")
    stream = lambda: status.events_stream(spark, where, spark.createDataFrame([], schema).schema)
    plans, decided = [], []
    for batch in ([(1, 1, "a"), (1, 2, "x")], [(1, 2, "x"), (1, 1, "z"), (1, 3, None)], [(1, 1, "a")], [(1, 1, "a"), (2, 1, "q")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
        out = status.incremental_renders(stream(), ledger, folder)
        decided.append(sorted((r.job_id, r.id, r.fingerprint, r.action, r.clip) for r in out.collect()))
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    new = [sorted(set(b) - set(a)) for a, b in zip([[], *decided], decided, strict=False)]
    assert new[0] == [(1, 1, "a", "reuse", "c1"), (1, 2, "x", "todo", None)]
    assert new[1] == [(1, 1, "z", "todo", None), (1, 2, "x", "reuse", "new_1_2")]
    assert new[2] == [(1, 1, "a", "todo", None)]
    assert new[3] == [(1, 1, "a", "reuse", "new_1_1"), (2, 1, "q", "todo", None)]
    assert len(set(plans)) == 1


def test_a_block_of_segments_is_one_state(spark, tmp_path):
    where, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id long, id long, fingerprint string"
    stream = lambda: status.events_stream(spark, where, spark.createDataFrame([], schema).schema)
    ids = [*range(600), -1, 2**60 + 1]
    ledger = spark.createDataFrame([(1, k, "a", f"c{k}") for k in ids[::2]] + [(7, 7, "a", "c")], schema + ", clip string")
    spark.createDataFrame([(1, k, f) for k in ids for f in ("a", "b", "b")] + [(1, None, "a"), (1, None, "a")], schema).coalesce(1).write.mode("append").parquet(where)
    out = status.incremental_renders(stream(), ledger, folder)
    want = [(1, None, "a", "todo", None), (1, None, "a", "reuse", "new_1_None")]
    for k in ids:
        want += [(1, k, "a", *(("reuse", f"c{k}") if k in ids[::2] else ("todo", None))), (1, k, "b", "todo", None), (1, k, "b", "reuse", f"new_1_{k}")]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert spark.read.format("statestore").option("stateVarName", "clips").load(f"{folder}/offsets").count() == 7


def test_last_values_of_a_job_keep_their_precision(spark, tmp_path):
    where, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "job_id long, seq long, value long"
    stream = lambda: status.events_stream(spark, where, spark.createDataFrame([], schema).schema)
    for batch in ([(1, 1, None), (1, 2, 2**53 + 1), (2, 7, None), (2, 7, 3)], [(2, 7, None), (1, 1, 5), (3, 1, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
        got = status.latest_status_stream(stream(), "job_id", "seq", ["value"], folder)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 3, 2**53 + 1), (2, 7, 3, 3), (3, 1, 1, None)]
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
