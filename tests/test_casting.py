"""Casting, lost files, headings, alignment in blocks and timelines on small inputs worked out by hand or by plain loops."""

from __future__ import annotations

import random
import sys
import types

import pytest
from pyspark.sql import functions as F

from fabula.operators import casting as V
from fabula.operators import production as P
from fabula.plans import alignment as W
from fabula.plans import stages
from fabula.sources import artifacts as A


def test_profiles_without_default_or_rows(spark):
    lines = spark.createDataFrame([(1, "Ann"), (2, None), (3, "Bo")], "id int, speaker string")
    profiles = spark.createDataFrame([("Ann", "b"), ("Ann", "a"), ("Bo", None)], "speaker string, voice string")
    assert {r.id: r.voice for r in V.with_profiles(lines, profiles, "Eric").collect()} == {1: "a", 2: "Eric", 3: "Eric"}
    assert {r.voice for r in V.with_profiles(lines, profiles.limit(0), "Eric").collect()} == {"Eric"}


def test_no_default_backend_fails(spark):
    known = A.backends(spark.createDataFrame([('{"a": "u"}',), (None,)], "text string"))
    assert [r.urls for r in V.routed(spark.createDataFrame([("a",)], "engine string"), known, "zz").collect()] == [["u"]]
    with pytest.raises(Exception, match="no backend for engine"):
        V.routed(spark.createDataFrame([("b",), (None,)], "engine string"), known, "zz").collect()


def test_lost_clips(spark):
    files = spark.createDataFrame([("/w/seg0001.wav", 1), ("/w/seg0002_a.wav", 5), ("/w/seg0002_b.wav", 5), ("/x/seg0003_a.wav", 9), ("/w/seg0002_c.txt", 9), ("/w/seg12345_a.wav", 2)], "path string, modified int")
    clips = spark.createDataFrame([(1, 1, "/w/seg0001.wav"), (1, 2, "/w/seg0002.wav"), (1, 3, "/w/seg0003.wav"), (1, 12345, "/w/gone.wav"), (1, None, None)], "job_id int, id int, path string")
    got = {r.id: (r.file, r.found) for r in V.resolved_clips(clips, files).collect()}
    assert got == {1: ("/w/seg0001.wav", "there"), 2: ("/w/seg0002_b.wav", "latest"), 3: (None, "missing"), 12345: ("/w/seg12345_a.wav", "latest"), None: (None, "missing")}


def test_headings(spark):
    rows = [(1, 1, "narration", " One ", "unknown"), (1, 2, "dialogue", "One", "Bo"), (2, 1, "narration", "x", "narrator"), (3, 1, "dialogue", "", "Bo")]
    segments = spark.createDataFrame(rows, "chapter_id int, id int, kind string, original_text string, speaker string")
    headings = spark.createDataFrame([(1, "One\n"), (2, None), (3, "")], "chapter_id int, heading string")
    got = {(r.chapter_id, r.id): (r.kind, r.speaker) for r in V.mark_headings(segments, headings).collect()}
    assert got == {(1, 1): ("heading", "narrator"), (1, 2): ("dialogue", "Bo"), (2, 1): ("narration", "narrator"), (3, 1): ("dialogue", "Bo")}


def test_blocks_join_without_a_seam(spark):
    def late_aligner(chapter, words, start, end):
        """Words last by their length; nothing goes beyond the end of the span."""
        out, at = [], 0.0
        for w in words:
            out.append((min(at, end - start), min(at + len(w) / 8, end - start), 1.0))
            at += len(w) / 8
        return out

    rng = random.Random(3)
    chapters = [(k, ["a" * rng.randint(1, 4) for _ in range(n)]) for k, n in enumerate((1, 10, 11, 57, 240))]
    rows = [(k, w, sum(map(len, w)) / 8) for k, w in chapters] + [(9, [], 0.0), (10, None, None)]
    df = spark.createDataFrame(rows, "chapter_id long, words array<string>, seconds double")
    whole = {tuple(r) for r in W.aligned(df, late_aligner).collect()}
    assert len(whole) == 319
    assert {tuple(r) for r in W.aligned(df, late_aligner, block=10, tail=3, cells=0).collect()} == whole
    assert {tuple(r) for r in W.aligned(df, late_aligner, block=2, tail=5, cells=0).collect()} == whole
    blocks = df.select("chapter_id", F.explode(W.word_blocks(F.size(F.coalesce("words", F.array())), 10, 3)).alias("b")).collect()
    for k, w in chapters:
        own = [r.b for r in blocks if r.chapter_id == k]
        assert own[-1].kept == own[-1].last == len(w) and all(a.kept == b.first for a, b in zip(own, own[1:]))


def test_timeline_streams(spark):
    rng = random.Random(5)
    clips = [(j, i, rng.choice((0, 0, 300, None)), rng.choice((10, 40, 500))) for j in range(7) for i in range(1 if j == 3 else 400)]
    want, at, last = {}, 0, None
    for j, i, pause, long in clips:
        at = 0 if j != last else at
        last = j
        start = at + pause if pause else at - 50 if at > 50 else at
        at = start + long
        want[j, i] = start
    rng.shuffle(clips)
    got = P.timeline(spark.createDataFrame(clips, "job_id int, id int, pause_before_ms int, duration_ms int")).collect()
    assert {(r.job_id, r.id): r.start_ms for r in got} == want
    assert {r.total_ms for r in got if r.job_id == 3} == {[c for c in clips if c[0] == 3][0][3] + want[3, 0]}
    assert P.timeline(spark.createDataFrame([], "job_id string, id int, pause_before_ms int, duration_ms int")).count() == 0


def test_median_of_ties_and_nulls(spark):
    runs = [("a", 2.0, 1.0), ("a", 2.0, 1.0), ("a", 1.0, 1.0), ("a", None, 1.0), ("a", 5.0, 1.0), ("b", 3.0, 2.0), ("c", None, 1.0)]
    got = {r["case"]: (r.segments, r.median_s, r.max_s, r.rtf) for r in P.bench_stats(spark.createDataFrame(runs, "case string, elapsed_s double, audio_s double")).collect()}
    assert got == {"a": (5, 2.0, 5.0, 2.0), "b": (1, 3.0, 3.0, 1.5), "c": (1, None, None, None)}


def test_cast_file_lines(spark):
    text = "# top\r\nvoices:\r\n  Ann Lee:\r\n    speed: 0.9 # slow\r\n    notes: 'a # b'\r\n\r\n  'Bo':\r\n    engine: x\r\nother:\r\n  Cy:\r\n    engine: y\r\n"
    got = {tuple(r) for r in A.voice_profiles(spark.createDataFrame([(1, text), (2, ""), (3, None)], "cast int, text string")).collect()}
    assert got >= {(1, "Ann Lee", "speed", "0.9"), (1, "Bo", "engine", "x")} and len(got) == 3


def test_older_tables_get_new_columns(spark):
    old = spark.createDataFrame([(1, "x", "gone")], "id int, name string, extra string")
    assert A.with_schema(old, "id long, name string, speaker_raw string").collect() == [(1, "x", None)]


def test_stage_modules_are_found(tmp_path, monkeypatch):
    (tmp_path / "found_stages").mkdir()
    for name, body in {"__init__": "", "_hidden": "1/0", "base": "1/0", "shout": "SEEN = True"}.items():
        (tmp_path / "found_stages" / f"{name}.py").write_text(body)
    monkeypatch.syspath_prepend(str(tmp_path))
    import found_stages

    assert isinstance(found_stages, types.ModuleType) and stages.discover(found_stages) == ["shout"]
    assert sys.modules["found_stages.shout"].SEEN


def test_aligned_words_leave_as_whole_batches(spark):
    from fabula.plans import alignment as W

    rows = [(k, [f"w{k}", "é", "x" * k][: k % 4], 1.0 + k) for k in range(9)] + [(90, None, 2.0), (91, [], None), (None, ["a"], 1.0)]
    out = W.aligned(spark.createDataFrame(rows, "chapter_id long, words array<string>, seconds double"), lambda c, words, a, b: [(i * 1.0005, i + 0.0625, None) for i in range(len(words))], block=2, tail=1, cells=1.0)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.chapter_id or -1, r.idx, r.word, r.start, r.score) for r in out.collect())
    want = sorted((k if k else -1, i, w) for k, words, _ in rows if words for i, w in enumerate(words))
    assert [(k if k else -1, i, w) for k, i, w, _, _ in got] == [((-1 if k is None else k), i, w) for k, i, w in want] and all(x[4] is None for x in got)
