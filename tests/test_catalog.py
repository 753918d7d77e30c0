"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from fabula.catalog import casting, chapters, corpora, library, mechanisms, production, shelves

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (chapters, corpora, production, casting, library, shelves, mechanisms)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    done = duck.execute(SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in done.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_order_of_input_does_not_matter(spark):
    from fabula.operators import segments as S

    c = chapters.chapters(spark, SF)
    one = {tuple(r) for r in S.take_turns(S.attribute_explicit(S.split_segments(c))).collect()}
    two = {tuple(r) for r in S.take_turns(S.attribute_explicit(S.split_segments(c.orderBy("text").repartition(3)))).collect()}
    assert one == two


def test_whole_turns_are_aligned(spark, tmp_path):
    texts = ["ab cde " * 60 + "end", "short one", None, "x" * 250 + " tail"]
    spark.createDataFrame([(7, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.segment_id: r for r in QUERIES["align_spans"](spark, str(tmp_path)).collect()}
    score, speech = [], 0.0
    for k, t in enumerate(texts):
        words = (t or "").split(" ")
        own = [((len(w) * 7 + i * 3) % 97) / 97 for i, w in enumerate(words)]
        length = (len(words) - 1) * 0.5 + len(words[-1]) * 0.05
        assert got[k].words == len(words) and abs(got[k].mean_score - sum(own) / len(own)) < 6e-4
        assert got[k].start == k * 100 and abs(got[k].duration - length) < 1e-6
        score, speech = score + own, speech + length
    (h,) = QUERIES["align_health"](spark, str(tmp_path)).collect()
    assert h.word_count == len(score) and h.low_confidence_words == sum(s < 0.5 for s in score)
    assert abs(h.speech_ratio - speech / (300 + 119.37)) < 1e-4


def test_whole_texts_are_normalised(spark, tmp_path):
    lead = "Plain words that go on and on until the mark of eighty letters lies well behind us here"
    texts = {4: f"{lead}\n* * *\nThe end & 3/4 of [it]", 6: "A ring of old silver worth its weight Q9", 7: f"{lead}\n-----\nlast"}
    spark.createDataFrame([(i, t, 123) for i, t in texts.items()], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spoken = {r.doc_id: r.spoken for r in QUERIES["normalise_text"](spark, str(tmp_path)).collect()}
    assert spoken[4] == f"{lead}. Thee end and three out of four of it"
    assert spoken[6] == "Item: A ring of old silver worth its weight Q9, rank twenty-three out of four"
    assert spoken[7] == f"{lead}. last"
    breaks = {r.doc_id: r for r in QUERIES["normalise_scene_breaks"](spark, str(tmp_path)).collect()}
    assert breaks[4].had_break and breaks[4].kept == f"{lead}\nThe end & 3/4 of [it]"
    assert not breaks[6].had_break
    assert breaks[7].had_break and breaks[7].kept == f"Effect: ??\n{lead}\nlast"


def test_every_pair_of_labels_is_guarded(spark):
    labels = {(r.book_id, r.label) for r in corpora.C.label_counts(corpora.segments(spark, SF)).collect()}
    got = QUERIES["registry_guard"](spark, SF).collect()
    assert len(got) == sum(1 for a in labels for b in labels if a[0] == b[0]) + len(labels)
