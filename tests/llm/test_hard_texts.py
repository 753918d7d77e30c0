"""Very long texts, very many matches, extreme numbers: what once took quadratic time, ended a task or lost rows."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import ann, packing, queries, secrets, toxicity

# 3


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\r\n"])
def test_long_white_space_is_packed(spark, run):
    from tokenizers import Tokenizer

    texts = [run * (2_000_000 // len(run)), "a b" + run * 5000 + "c d", "end" + run * 600, "<|endoftext|>" + run * 600 + "<|endoftext|>", run * 700 + "start"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(bytes)
    for r in packing.tokenised(docs, queries.tokenizer_path()).orderBy("doc_id", "piece").collect():
        got[r.doc_id] += bytes(r.ids)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], dtype="<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


# 5


def took(work):
    began = time.time()
    return work(), time.time() - began


def test_many_secrets_in_a_text(spark):
    """A megabyte of assignments, of hex lines and of random tokens; masking is held against the spans in Python."""
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    shapes = [
        lambda n: "password=abcdef1 " * (n // 17),
        lambda n: "\n".join("%064x" % rng.getrandbits(256) for _ in range(n // 65)),
        lambda n: "é ".join("".join(rng.choice(letters) for _ in range(24)) for _ in range(n // 26)),
    ]
    for k, shape in enumerate(shapes):
        times = []
        for n in (250_000, 500_000, 1_000_000):
            text = shape(n)
            docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
            spans, seconds = took(lambda d=docs: secrets.scanned(d).first()["spans"])
            masked, more = took(lambda d=docs: secrets.redacted(d).first()["text"])
            times.append(seconds + more)
            if n == 250_000:
                want, at = [], 0
                for s in spans:
                    want.append(text[at : s.start] if s.start > at else "")
                    want.append("[secret]" if s.start >= at else "")
                    at = max(at, s.end)
                assert masked == "".join(want).replace("[secret][secret]", "[secret][secret]") + text[at:]
                assert len(spans) >= 0.8 * text.count(" " if k != 1 else "\n")
        assert times[2] < 45 and times[2] < 4 * times[1] + 2, times


# 6


def test_long_words_unspaced_scripts_and_exceptions(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij") for _ in range(60))
    other = long[:40] + "".join(rng.choice("klmnop") for _ in range(20))
    filler = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(30))
    rows = [(k, f"{filler()} {long} {filler()}", 1) for k in range(20)] + [(100 + k, f"{filler()} {other} {filler()}", 0) for k in range(20)]
    sign = lambda n: "".join(rng.choice("上下左右东南西北山水火木金土日月年") for _ in range(n))
    rows += [(200 + k, f"{sign(4)}天气很好坏蛋{sign(3)}走吧", 1) for k in range(20)] + [(300 + k, f"{sign(4)}天气很好{sign(3)}走吧", 0) for k in range(20)]
    rows += [(400 + k, filler(), 0) for k in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert long + " " in lexicon.weights and not any(e == other[: len(e)] for e in lexicon.weights)
    assert lexicon.weight(f"before {long} after") > 0 and lexicon.weight(f"before {other} after") == 0
    assert lexicon.weight("很长的一句话里面也有坏蛋两个字") > 0 and lexicon.weight("很长的一句话里面没有") == 0

    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash ": 2.0}, ("trash can",))
    text = "trash can idiot " * 65_000
    weight, seconds = took(lambda: lexicon.weight(text))
    assert weight == pytest.approx(65_000 / (toxicity.folded(text).count(" ") / 100) ** 0.5) and seconds < 10


# 8


@pytest.mark.parametrize("kind", ["one huge", "one tiny", "mixed", "all huge", "beyond", "negative"])
def test_neighbours_of_any_size(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    size = {"one huge": 1e200, "one tiny": 1e-200, "all huge": 1e150, "beyond": 1e300, "negative": 1.0}.get(kind, 1.0)
    if kind == "mixed":
        v *= 10.0 ** rng.integers(-100, 100, (400, 1))
    elif kind == "all huge":
        v *= size
    elif kind == "negative":
        v = -np.abs(v)
        v[1::2] *= -1
    else:
        v[17] = size * np.sign(v[17])
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 400, 20):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        assert len(got[q]) == 20 and all(score == pytest.approx(s[i], rel=1e-12) for i, score in got[q])
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-s[i], i))
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
    assert hits >= 0.95 * 400


def test_scores_beyond_a_double(spark):
    v = [[1e200, 0.0], [1e200, 1.0], [2e200, 0.0], [-1e200, 5.0], [3.0, 1.0], [1e308, 1e308]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id = 0"), k=20).orderBy("rank").collect()]
    assert got == [(5, float("inf")), (2, float("inf")), (1, float("inf")), (4, pytest.approx(3e200)), (3, float("-inf"))]


def test_a_query_without_its_neighbours_is_an_error(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "vec_id long")
    found = spark.createDataFrame([(0, i) for i in range(1, 4)], "query_id long, vec_id long")
    ann._guarded(found, rows.filter("vec_id = 0"), rows, 3)
    with pytest.raises(RuntimeError):
        ann._guarded(found, rows.filter("vec_id = 0"), rows, 4)
    with pytest.raises(RuntimeError):
        ann._guarded(found, rows.filter("vec_id < 2"), rows, 3)


# very long texts of the others


def test_a_very_long_url(spark):
    from fabula.llm import url_filter

    host = "a" * 1_000_000
    urls = [f"http://{host}.com/en/" + "p" * 1_000_000 + "?" + "&".join(f"k{n}=v" for n in range(20_000)), "http://x.net/de/" + "/" * 500_000, "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judged(pages, queries.URL_RULES, pages.filter("page_id = 1").select("url")).collect()}
    assert (got[0].host, got[0].rule, got[0].verdict) == (f"{host}.com", "com/en/", "block") and len(got[0].path) == 1_000_004
    assert (got[1].rule, got[1].verdict) == ("net/de/", "allow") and (got[2].host, got[2].path, got[2].verdict) == ("", "", "allow")


def test_a_very_long_turn(spark):
    import hashlib

    from fabula.llm import chat

    texts = ["<|im_end|>" * 100_000, "é" * 1_000_000, "<\\\\|im_start|>" * 50_000]
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    (r,) = chat.read_back(chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert r.n_turns == 3 and r.loss_chars == 1_000_000 and r.loss_sha256 == hashlib.sha256(texts[1].encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()


def test_very_long_documents_are_linked(spark):
    from fabula.llm.neardup import near_duplicates

    rng = random.Random(3)
    words = [f"w{rng.randrange(1 << 40)}" for _ in range(150_000)]
    texts = [" ".join(words), " ".join(words[:140_000]), " ".join(words[:75_000]), "x " * 1_000_000, "x" * 2_000_000, " " * 2_000_000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=75).collect()}
    assert got == {0: (149_996, 0), 1: (139_996, 0), 2: (74_996, 2), 3: (1, 3), 4: (1, 4), 5: (0, 5)}


def test_very_long_documents_are_judged(spark):
    from fabula.llm import quality

    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(9)) for _ in range(20_000)]
    texts = ["\n".join(lines), "\n".join(lines * 2), "a" * 2_000_000, "# " * 500_000]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert (got[0].n_words, got[0].n_dup_lines, got[0].n_repeat_words, got[0].kept) == (180_000, 0, 0, True)
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words, got[1].base_failed) == (360_000, 20_000, 360_000, True)
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 2_000_000, True) and got[3].n_symbols == 500_000


def test_very_long_documents_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(200)) for _ in range(30)]
    texts = [*plain, " \n" * 600_000 + plain[0], plain[1] + " password=abcdef1" * 5000, "\t" * 1_000_000, None, ""]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in pieces}) >= 20 and all(0 < r.length <= 1024 for r in pieces)
    place = defaultdict(list)
    for r in pieces:
        place[r.sequence_id].append((r.offset, r.length))
    for own in place.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
