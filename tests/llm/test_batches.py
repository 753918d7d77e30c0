"""How many rows with whole texts a task and its Python worker hand each other at once."""

from __future__ import annotations

import pyarrow as pa

from fabula.llm import neardup, toxicity
from fabula.llm.shared import pieces


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Ten thousand texts at once, and all their sets at once, took an executor more than its 3000 MB."""
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    plain = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: rows.append(int(spark.conf.get(key))) or plain(df, name))
    was = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in neardup.deduplicated(docs).collect()} == {1, 3}
    assert rows and max(rows) <= 1000 and spark.conf.get(key) == was
    texts = [" ".join(f"{k}w{i}" for i in range(150_000)) for k in range(4)]
    out = list(neardup._shingled([pa.RecordBatch.from_pydict({"text": texts})]))
    assert [len(b) for b in out] == [1] * 4 and {len(b.column("shingles")[0]) for b in out} == {149_996}


def test_pieces_are_the_whole_batch():
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    assert [len(p) for p in pieces(batch)] == [1000, 1000, 500]
    assert [x for p in pieces(batch) for x in p.column("x").to_pylist()] == list(range(2500))


def test_toxicity_keeps_all_columns_of_more_than_one_piece(spark):
    docs = spark.range(2500).selectExpr("id AS doc_id", "if(id % 2 = 0, 'you idiot', 'a calm day') AS text", "id * 2 AS twice").coalesce(1)
    out = toxicity.accepted(docs, toxicity.Lexicon({"idiot": 9.0})).collect()
    assert sorted(r.doc_id for r in out) == list(range(1, 2500, 2)) and all(r.twice == 2 * r.doc_id for r in out)
