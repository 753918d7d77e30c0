"""Empty tables give empty results."""

from __future__ import annotations

from fabula.llm import chat, langid, quality, secrets, toxicity


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(turns)).count() == 0
    assert secrets.scanned(docs).count() == 0 and secrets.redacted(docs).count() == 0
    assert quality.quality(docs).count() == 0 and quality.cleaned(docs).count() == 0
    lexicon = toxicity.Lexicon({"abc": 1.0})
    assert toxicity.scored(docs, lexicon).count() == 0 and toxicity.accepted(docs, lexicon).count() == 0
    assert langid.identify(docs, docs).count() == 0
