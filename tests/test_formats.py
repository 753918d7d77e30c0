"""EPUB, WAV and voice folders through ``spark.read.format``, against the functions over whole files."""

from __future__ import annotations

import json
import wave

import pytest
from test_plans import book

from fabula.sources import artifacts, epub, formats


def waves(folder):
    for k, (name, seconds) in enumerate((("b.wav", 2), ("a.WAV", 1), ("c.wav", 0))):
        with wave.open(str(folder / name), "wb") as w:
            w.setnchannels(1 + k % 2)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"\0\0" * (1 + k % 2) * 8000 * seconds)
    (folder / "broken.wav").write_bytes(b"RIFF")
    (folder / "empty.wav").write_bytes(b"")
    (folder / "note.txt").write_text("x")


def test_books(spark, tmp_path):
    formats.register(spark)
    book(tmp_path / "x.epub", [("1. Strange Days", "c%200.html"), ("2) The End", "c%202.html")])
    book(tmp_path / "y.epub", [("4. Nowhere", "no.html"), ("3 - New", "c%203.html#a")])
    rows = spark.read.format("epub").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2
    plain = lambda df: sorted((r.book.rpartition("/")[2], r.number, r.title, r.text, r.word_count) for r in epub.chapters(df).collect())
    assert plain(rows) == plain(epub.epub_parts(spark, str(tmp_path))) and len(plain(rows)) == 3
    few = spark.read.format("epub").schema("book string, pos int").load(f"file://{tmp_path}")
    assert few.columns == ["book", "pos"] and few.count() == rows.count()
    one = spark.read.format("epub").load(str(tmp_path / "y.epub"))
    assert {r.book.rpartition("/")[2] for r in one.collect()} == {"y.epub"}


def test_wave_headers(spark, tmp_path, monkeypatch):
    formats.register(spark)
    waves(tmp_path)
    rows = spark.read.format("wav").option("filesPerPartition", 2).load(str(tmp_path))
    got = {r.file: (r.seconds, r.frames, r.rate, r.channels) for r in rows.collect()}
    assert got == {"a.WAV": (1.0, 8000, 8000, 2), "b.wav": (2.0, 16000, 8000, 1), "c.wav": (0.0, 0, 8000, 1), "broken.wav": (0.0, 0, 0, 0), "empty.wav": (0.0, 0, 0, 0)}
    assert rows.rdd.getNumPartitions() == 3
    sizes = spark.read.format("wav").schema("file string, bytes long").load(str(tmp_path))
    assert {r.file: r.bytes for r in sizes.collect()}["b.wav"] == (tmp_path / "b.wav").stat().st_size
    (tmp_path / "none").mkdir()
    assert spark.read.format("wav").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)missing|FileNotFound"):
        spark.read.format("wav").load(str(tmp_path / "missing")).count()


def test_voices(spark, tmp_path):
    formats.register(spark)
    waves(tmp_path)
    (tmp_path / "a.WAV").rename(tmp_path / "a.wav")
    (tmp_path / "empty.wav").unlink()  # whole-file reads leave empty files out
    (tmp_path / "builtin.json").write_text(json.dumps(["a.wav", "gone.wav"]))
    got = spark.read.format("voices").option("manifest", str(tmp_path / "builtin.json")).load(str(tmp_path)).orderBy("file").collect()
    want = artifacts.voice_files(spark, str(tmp_path), spark.createDataFrame([("a.wav",), ("gone.wav",)], "file string")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
