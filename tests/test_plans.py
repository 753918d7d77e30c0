"""Pipelines, model seams, sources, sinks and streams on small inputs of our own."""

from __future__ import annotations

import io
import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from fabula.functions import media
from fabula.operators import corpus
from fabula.plans import models, stages
from fabula.sources import artifacts, epub
from fabula.streaming import status


def test_pipelines_are_edited_and_checked():
    whole = stages.Pipeline.from_names(stages.DEFAULT)
    assert whole.problems() == [] and whole.index_of("turn_taking") == 2
    extra = stages.Stage("extra", ("mood",), (), lambda df: df)
    assert whole.append(extra).names[-1] == whole.insert_after("normalisation", extra).names[-1] == "extra"
    assert whole.insert_before("turn_taking", extra).index_of("extra") == 2 and whole.replace("turn_taking", extra).names[2] == "extra"
    with pytest.raises(stages.OrderError, match="extra needs mood"):
        whole.append(extra).validate()
    with pytest.raises(stages.OrderError):
        whole.remove("segment_splitter").validate()
    for bad in (lambda: whole.index_of("nothing"), lambda: stages.registered("nothing")):
        with pytest.raises(KeyError):
            bad()
    for stage in (extra.__class__("", (), (), extra.run), stages.REGISTRY["turn_taking"]):
        with pytest.raises(ValueError):
            stages.register(stage)


def test_times_by_kind(spark):
    rows = spark.createDataFrame([("a", "plain", 4), ("b", "model", 10), ("c", "plain", 1)], "name string, kind string, ms long")
    assert tuple(stages.time_by_kind(rows).first()) == (15, 5, 10)
    assert tuple(stages.time_by_kind(rows.limit(0)).first()) == (0, 0, 0)


def test_a_failing_model_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "dialogue", "Hi", "unknown", "none"), (1, 2, "narration", "Ann sat.", "narrator", "none")], "chapter_id long, id int, kind string, original_text string, speaker string, attribution_source string")
    names = spark.createDataFrame([(1, "Ann")], "chapter_id long, name string")

    def fails(prompt):
        raise TimeoutError

    assert sorted(models.attribute_by_model(rows, names, fails).collect()) == sorted(rows.collect())
    got = models.attribute_by_model(rows, names, lambda p: json.dumps({"attributions": [{"segment_id": 1, "speaker": "Ann "}]})).filter("id = 1").first()
    assert (got.speaker, got.attribution_source) == ("Ann", "ai")
    assert {(r.emotion, r.intensity) for r in models.emotions_by_model(rows, fails).collect()} == {("neutral", 0.5)}


def book(path, points):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        z.writestr("OEBPS/b.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest>' + "".join(f'<item id="i{k}" href="c%20{k}.html"/>' for k in range(4)) + '</manifest><spine><itemref idref="i0"/><itemref idref="gone"/>' + "".join(f'<itemref idref="i{k}"/>' for k in (1, 2, 3)) + "</spine></package>")
        nav = "".join(f"<navPoint><navLabel><text>{label}</text></navLabel><content src='{src}'/></navPoint>" for label, src in points)
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{nav}</navMap></ncx>')
        z.writestr("OEBPS/c 0.html", "<html><head><title>no</title></head><body><h1>1. Strange  Days</h1><p>One &amp; <b>two</b></p><script>x</script></body></html>")
        z.writestr("OEBPS/c 1.html", "<p>more</p>")
        z.writestr("OEBPS/c 2.html", "<p>2</p><h2>THE END</h2><p>text</p>")
        z.writestr("OEBPS/c 3.html", "<p>skip</p><div id='a'>3</div><p>last words</p>")


def test_epub_chapters(spark, tmp_path):
    book(tmp_path / "x.epub", [("1. Strange Days", "c%200.html"), ("Part two", "c%202.html"), ("2) The End", "c%202.html"), ("3 - New", "c%203.html#a"), ("4. Nowhere", "no.html")])
    got = {r.number: r for r in epub.chapters(epub.epub_parts(spark, str(tmp_path))).collect()}
    assert {n: r.text for n, r in got.items()} == {1: "Strange Days\nOne & two\nmore", 2: "THE END\ntext", 3: "New\nlast words"}
    assert got[1].title == "Strange Days" and got[1].word_count == 5


def test_artifacts(spark, tmp_path):
    seg = {"segments": [{"id": 1, "kind": "dialogue", "speaker": "A", "text": "Hi"}, {"id": 2, "kind": "narration", "speaker": "narrator", "text": "So."}], "characters": [{"name": "A", "gender": "male", "male_votes": 2, "female_votes": 0}]}
    words = [{"word": w, "segment_id": s, "start": t, "end": t + 0.5, "score": 0.9} for w, s, t in (("hi", 1, 0.0), ("so", 2, 1.0), ("it", 2, 2.0))]
    for name, data in (("seg/ch003.json", seg), ("seg/ch004.json", seg), ("al/ch003.json", {"audio_offset_s": 10.0, "words": words, "segments": [{"segment_id": 1, "start": 0.0, "end": 0.5, "words": 1, "mean_score": 0.9}]})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data, indent=1))
    segments, spans = artifacts.chapter_segments(spark, str(tmp_path / "seg")), artifacts.aligned_spans(spark, str(tmp_path / "al"))
    assert sorted((r.chapter_number, r.id, r.speaker) for r in segments.collect()) == [(3, 1, "A"), (3, 2, "narrator"), (4, 1, "A"), (4, 2, "narrator")]
    assert artifacts.chapter_votes(spark, str(tmp_path / "seg")).count() == 2
    got = artifacts.aligned_words(spark, str(tmp_path / "al")).orderBy("segment_id", "idx").collect()
    assert [(r.segment_id, r.idx, r.word, r.start) for r in got] == [(1, 0, "hi", 10.0), (2, 0, "so", 11.0), (2, 1, "it", 12.0)]
    states = artifacts.load_state(segments, spans, spark.createDataFrame([(3,), (4,), (5,)], "chapter_number int"))
    assert {r.chapter_number: r.state for r in states.collect()} == {3: "loaded", 4: "not_aligned", 5: "skipped_no_segments"}
    (tmp_path / "q.tsv").write_text('quote_start\tchar_id\tquote\n1\tc1\t"He ""said"""\n')
    assert [tuple(r) for r in artifacts.tab_table(spark, str(tmp_path / "q.tsv"), "quote string, quote_start int, more string").collect()][0][1:] == (1, None)
    assert artifacts.tab_table(spark, str(tmp_path / "none.tsv"), "a int").count() == 0
    (tmp_path / "w.txt").write_text("# verbs\nSaid\n\nsaid\nasked\n")
    assert sorted(r.word for r in artifacts.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["asked", "said"]
    (tmp_path / "p.txt").write_text("# x=1\nsad=low, a = b\nnothing\n")
    assert [tuple(r) for r in artifacts.phrases(spark, str(tmp_path / "p.txt")).collect()] == [("sad", "low, a = b")]


def test_voice_files(spark, tmp_path):
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\0\0" * 4000)
    (tmp_path / "b.wav").write_bytes(data.getvalue())
    (tmp_path / "a.wav").write_bytes(b"junk")
    (tmp_path / "c.txt").write_text("x")
    got = artifacts.voice_files(spark, str(tmp_path), spark.createDataFrame([("a.wav",)], "file string")).collect()
    assert [tuple(r) for r in got] == [("a.wav", 0.0, True), ("b.wav", 0.5, False)]


def test_chapter_tables_replace_only_their_chapters(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "book_id int, chapter_number int, text string")
    artifacts.write_chapter_table(rows, str(tmp_path / "t"))
    artifacts.write_chapter_table(spark.createDataFrame([(1, 2, "new")], rows.schema), str(tmp_path / "t"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "c", "new"]
    artifacts.write_manifest(rows.select("text", "text"), str(tmp_path / "m"), sep="|", header=False)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["a|a", "b|b", "c|c"]
    assert artifacts.not_done(rows, rows.filter("book_id = 1"), ["book_id", "chapter_number"]).count() == 1


def test_stored_verdicts_lose_vetoed_targets(spark):
    schema = "book_id int, name string, canonical string, confidence double, verdict string"
    old = spark.createDataFrame([(1, "A", "B", 0.9, "merge"), (1, "Z", None, 0.1, "proposed")], schema)
    out = corpus.store_verdicts(old, spark.createDataFrame([(1, "A", "B", 0.9, "vetoed:self"), (1, "C", "D", 0.7, "merge")], schema))
    assert {r.name: r.canonical for r in out.collect()} == {"A": None, "Z": None, "C": "D"}
    assert [(r.alias, r.canonical) for r in corpus.verdict_aliases(out).collect()] == [("C", "D")]


def test_unsafe_ids_fail(spark):
    df = spark.createDataFrame([("ok",), ("../x",)], "i string").select(media.safe_id(F.col("i")).alias("i"))
    with pytest.raises(Exception, match="unsafe id"):
        df.collect()
    assert df.filter("i = 'none'").limit(0).count() == 0


def test_streams_follow_new_files(spark, tmp_path):
    folder, where = str(tmp_path / "state"), str(tmp_path / "in")
    schema = "job_id long, seq long, phase string"
    source = lambda: status.events_stream(spark, where, spark.createDataFrame([], schema).schema)
    spark.createDataFrame([(1, 1, "analyzing"), (2, 2, "analyzing")], schema).write.mode("append").parquet(where)
    status.latest_status_stream(source(), "job_id", "seq", ["phase"], folder)
    spark.createDataFrame([(1, 3, "done"), (3, 4, "error")], schema).write.mode("append").parquet(where)
    got = status.latest_status_stream(source(), "job_id", "seq", ["phase"], folder)
    assert sorted(tuple(r) for r in got.select("job_id", "events", "phase").collect()) == [(1, 2, "done"), (2, 1, "analyzing"), (3, 1, "error")]


def test_incremental_renders(spark, tmp_path):
    schema, where = "job_id long, id long, fingerprint string", str(tmp_path / "in")
    ledger = spark.createDataFrame([(1, 1, "a", "c1"), (1, 2, "old", "c2")], "job_id long, id long, fingerprint string, clip string")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).coalesce(1).write.mode("append").parquet(where)
    stream = lambda: status.events_stream(spark, where, spark.createDataFrame([], schema).schema)
    first = status.incremental_renders(stream(), ledger, str(tmp_path / "out"))
    assert sorted((r.id, r.action) for r in first.collect()) == [(1, "reuse"), (2, "todo")]
    spark.createDataFrame([(1, 2, "b"), (1, 3, "c")], schema).coalesce(1).write.mode("append").parquet(where)
    both = status.incremental_renders(stream(), ledger, str(tmp_path / "out"))
    assert sorted((r.id, r.action) for r in both.collect()) == [(1, "reuse"), (2, "reuse"), (2, "todo"), (3, "todo")]


def test_wide_ids_get_their_emotions(spark):
    big = 60_000 * 100_000 + 7
    said = [{"id": big, "emotion": "happy", "intensity": 0.75}, {"id": "9" * 30, "emotion": "sad", "intensity": 1}, {"id": "x", "emotion": "sad", "intensity": 1}]
    clips = spark.createDataFrame([(1, big, "a"), (1, big + 1, "b")], "book_id long, id long, text string")
    got = models.clip_emotions(clips, lambda prompt: json.dumps({"emotions": said}))
    assert sorted(tuple(r) for r in got.collect()) == [(1, big, "happy", 0.75), (1, big + 1, "neutral", 0.5)]


def test_emotions_are_told_from_whole_texts(spark):
    def client(prompt):  # goes by the last word of a text
        says = {"furious": "angry", "smiling": "happy"}
        return json.dumps({"emotions": [{"id": x["id"], "emotion": says.get(x["text"].split()[-1], "calm"), "intensity": len(x["text"]) / 2e6} for x in json.loads(prompt)]})

    texts = ["word " * 80 + "furious", "word " * 200_000 + "smiling", "smiling", "word " * 59 + "ends furious", "\U0001f600" * 400 + " furious", "word " * 80]
    clips = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "book_id long, id long, text string")
    want = {k: ("happy" if "smiling" in t else "angry" if "furious" in t else "calm", len(t) / 2e6) for k, t in enumerate(texts)}
    assert {r.id: (r.emotion, r.intensity) for r in models.clip_emotions(clips, client, 2).collect()} == want
    lines = clips.selectExpr("book_id as chapter_id", "id", "'dialogue' as kind", "'' as speaker", "text as original_text")
    assert {r.id: (r.emotion, r.intensity) for r in models.emotions_by_model(lines, client).collect()} == want
