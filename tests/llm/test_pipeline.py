"""Each stage of the pipeline on its own input, and the whole on the smallest tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
from test_operators import water
from tokenizers import Tokenizer

from fabula.llm import mixing, oracles, queries, secrets, toxicity
from fabula.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        if name in ("toxicity", "near_dedup"):
            assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
            assert 0 < kept.count() < before.count()
        if name == "secrets":
            assert kept.count() == before.count()
            assert secrets.scanned(kept).selectExpr("sum(size(filter(spans, s -> s.kind < 3)))").first()[0] == 0
        if name == "mixing":
            mix = mixing.mixed(before)
            want = mix.select("doc_id", mixing.taken(mix).alias("taken")).collect()
            have = Counter()
            for r in kept.select("doc_id", mixing.word_count(kept.text).alias("n")).collect():
                have[r.doc_id] += r.n
            assert have == Counter({r.doc_id: r.taken for r in want if r.taken})
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_weight(lexicon, text):
    """Every entry tried at every place."""
    own = toxicity.folded(text)
    harmless = [(m, m + len(p) + 2) for p in lexicon.exceptions for m in range(len(own)) if own.startswith(f" {p} ", m)]
    total = 0.0
    for at in (k for k, c in enumerate(own) if c == " "):
        fits = [e for e in lexicon.weights if own.startswith(e, at + 1)]
        if fits and not any(a <= at and at + 1 + len(max(fits, key=len)) <= b for a, b in harmless):
            total += lexicon.weights[max(fits, key=len)]
    return total / max(1.0, own.count(" ") / 100) ** 0.5 if total else 0.0


def plain_groups(texts):
    """The smallest id that each can be reached from, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in texts}
    find = lambda i: i if low[i] == i else find(low[i])
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: find(i) for i in texts}


def test_stages_against_brute_force(spark):
    """Each stage on its own input, against a plain version that shares none of its code."""
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, df: written(stage[name](spark, df, SF), name)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = run("toxicity", docs)
    lexicon = queries.toxicity_lexicon(docs, spark, SF)
    assert texts(kept) == {i: t for i, t in texts(docs).items() if lexicon.score(plain_weight(lexicon, t)) < 0.5}

    before, kept = kept, run("near_dedup", kept)
    group = plain_groups(texts(before))
    assert texts(kept) == {i: t for i, t in texts(before).items() if group[i] == i} and len(set(group.values())) < len(group)

    before, kept = kept, run("secrets", kept)
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    masked, texts_of = {}, texts(before)
    for i, spans in con.execute(f"SELECT doc_id, spans FROM ({oracles.secret_scans()})").fetchall():
        text, out, at = texts_of[i], "", 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
            out += (text[at:a] if a > at else "") + ("[secret]" if a >= at else "")
            at = max(at, b)
        masked[i] = out + text[at:] if spans else text
    assert texts(kept) == masked and {r.doc_id: r.n_chars for r in kept.collect()} == {i: len(t or "") if masked[i] != texts_of[i] else n for i, t, n in ((r.doc_id, masked[r.doc_id], r.n_chars) for r in before.collect())}

    before, kept = kept, run("mixing", kept)
    words = {r.doc_id: (r.source, WORD.findall(r.text or "")) for r in before.collect()}
    sizes = Counter()
    for source, w in words.values():
        sizes[source] += len(w)
    want, got, times = water(sizes, 1.5, 2), Counter(), Counter()
    for r in kept.collect():
        own = WORD.findall(r.text)
        assert own == words[r.doc_id][1][: len(own)]
        got[r.source] += len(own)
        times[r.doc_id] += len(own)
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes) and all(n <= 2 * len(words[i][1]) for i, n in times.items())

    pieces = stage["packing"](spark, kept, SF).collect()
    plain, need, have = Tokenizer.from_file(queries.tokenizer_path()), defaultdict(Counter), defaultdict(Counter)
    for r in kept.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]):
            own = np.array(ids[at : at + (first if k == 0 else 1024)], dtype="<u4")
            need[r.doc_id][k, at, len(own), zlib.crc32(own.tobytes())] += 1
    for p in pieces:
        have[p.doc_id][p.piece, p.start, p.length, p.ids_crc32] += 1
    assert need == have
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    room = []
    for n in sorted((p.length for p in pieces), reverse=True):  # best fit, longest first
        best = min((k for k, left in enumerate(room) if left >= n), key=lambda k: room[k], default=None)
        if best is None:
            room.append(1024 - n)
        else:
            room[best] -= n
    assert max(fill.values()) <= 1024 and len(fill) <= len(room) + 1
