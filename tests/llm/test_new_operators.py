"""Manifest, sharding and tokenizer alignment against brute force, with nulls, empty and repeated rows, and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fabula.llm import bpe, merkle, queries, sharding, tokenalign

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def saved(spark, rows, path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """For each leaf its path, and the root."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            first = k - k % 8
            paths[leaf].append((nodes[first:k], nodes[k + 1 : first + 8]))
            at[leaf] = k // 8
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return paths, nodes[0]


def manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        leaf = H(*map(field, (i, source, lang, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        low = t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        groups[lang].append((i is not None, i or 0, leaf, H(*map(field, (i, source, lang, n, low))) if hit else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    above, root = tree([trees[g][1] for g in names])
    out = []
    for g, top in zip(names, above, strict=True):
        for (known, i, leaf, start), path in zip(sorted(groups[g]), trees[g][0], strict=True):
            h = start
            for before, after in path + top:
                h = H(*before, h, *after)
            out.append((i if known else None, leaf, trees[g][1], root, H(*[x for b, a in path + top for x in b + a]), h, h == root))
    return out


@pytest.mark.parametrize("langs", [(None, "", "de", "z", "é"), tuple("abcdefghijkl") + (None,), ("only",)])
def test_manifest(spark, tmp_path, langs):
    rng = random.Random(len(langs))
    rows = [(k if rng.random() < 0.95 else None, rng.choice([None, "", "Ab c", "é\n", f"Text {k}", "low"]), rng.choice(langs[:-1] or langs), rng.choice([None, "s"]), rng.choice([None, k])) for k in range(300)]
    rows += [rows[5]] * 9 + [(7, "other", langs[0], "s", 1), (1000, "Alone", langs[-1], "s", 1)]
    sf = saved(spark, rows, tmp_path)
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(manifest(rows), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op11_merkle_manifest"]).fetchall(), key=repr) == sorted(got, key=repr)


def test_manifest_of_few_rows_and_clashing_names(spark, tmp_path):
    for k, rows in enumerate([[], [(3, "Ab", None, "s", 2)], [(3, "Ab", "x", "s", 2), (4, "c", "y", "s", 1)]]):
        got = [tuple(r) for r in queries.op11_merkle_manifest(spark, saved(spark, rows, tmp_path / str(k))).collect()]
        assert sorted(got) == sorted(manifest(rows) if rows else [])
    docs = spark.createDataFrame([(1, "a", 5, "g")], "index long, node string, n int, group string")
    (r,) = merkle.manifest(docs, F.col("group"), "index", merkle.leaf(F.col("node")), {"n": F.col("n")}).collect()
    assert (r["index"], r.leaf, r.subroot, r.root, list(r.path), r.n) == (1, H("1:a"), H("1:a"), H("1:a"), [], 5)


def test_very_long_text_in_a_leaf(spark):
    text = "Aé" * 1_500_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert docs.select(merkle.leaf(F.col("text"))).first()[0] == H(field(text))


# 12


def load_of(rows):
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    return [load[k] for k in range(24)]


def test_shards_have_near_equal_bytes(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, ""] + [rng.choice("aé") * int(rng.paretovariate(1.2) * 50) for _ in range(3000)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = queries.op12_sharding(spark, saved(spark, rows, tmp_path)).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in enumerate(texts)}
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    load, largest = load_of(got), max(len((t or "").encode()) + 8 for t in texts)
    assert max(load) - min(load) <= max(0.01 * sum(load) / 24, largest - min(load))
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    again = queries.op12_sharding(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_hot_ids_are_split(spark):
    """A third of all rows has no id, a third the same one, and one id has most bytes; extra columns clash."""
    rows = [(None, "x" * 20, 1) for _ in range(2000)] + [(7, "", 1) for _ in range(2000)] + [(9, "y" * 500, 2) for _ in range(500)] + [(100 + k, "z" * 90, 3) for k in range(1500)]
    docs = spark.createDataFrame(rows, "id long, text string, slot int").withColumn("shard", F.lit("mine"))
    path = sharding.create(spark, 24)
    got = sharding.sharded(docs.select(F.col("id").alias("doc_id"), "text", F.struct("slot", "shard").alias("extra")), path, 24, carry=["extra"]).collect()
    assert Counter((r.id, r.size, r.extra.slot) for r in got) == Counter((i, len(t) + 8, s) for i, t, s in rows)
    load = load_of(got)
    assert max(load) < 1.02 * sum(load) / 24
    for shard in range(24):
        assert sorted(r.place for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert max(Counter((r.slot, r.piece) for r in got).values()) < 200


def test_versions_of_the_map_are_edits(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    path = sharding.create(spark, 10, slots=1000)
    sharding.sharded(docs, path, 10).count()
    (one, first), (two, second) = sharding.load(spark, path, 1), sharding.load(spark, path)
    assert (one, two) == (1, 2) and first == sharding.first_map(1000, 10)
    assert 0 < sum(first[u] != second[u] for u in first) < 300
    sharding.sharded(docs, path, 10).count()
    assert sharding.load(spark, path) == (3, second)
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save(spark, path, 3, second)
    have = sharding.weights(sharding.records(docs, 1000), 1000, 10)
    third = sharding.grown(second, have, 10)
    assert all(third[u] in (s, 10) for u, s in second.items())
    load = Counter()
    for u, s in third.items():
        load[s] += have[u].bytes
    assert len(load) == 11 and max(load.values()) - min(load.values()) < 0.15 * min(load.values())


def test_no_rows_in_shards(spark, tmp_path):
    assert queries.op12_sharding(spark, saved(spark, [], tmp_path)).count() == 0


# 13


def tokens(text):
    """(A ids, B ids) with their byte ranges, by the libraries alone; None where either does not give the bytes back."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a, tokens.b = Tokenizer.from_file(queries.tokenizer_path()), SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
        tokens.a.encode_special_tokens = True
    back = bpe._byte_of_char()
    a = [(i, bytes(back[c] for c in tokens.a.id_to_token(i))) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens.b.encode(text):
        p = tokens.b.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if text and whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else None


def ranges(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(texts):
    every, count = [], Counter()
    for t in texts:
        two = tokens(t) if t else None
        a, b = map(ranges, two) if two else ([], [])
        links = [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]
        count.update(links)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(",".join(str(i) for i, _, e in a if s < e <= x), ",".join(str(i) for i, _, e in b if s < e <= x)) for s, x in zip([0, *cuts], cuts, strict=False)]
        every.append((len(a), len(b), len(cuts), links, ";".join(f"{x}|{y}" for x, y in groups)))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(na, nb, ng, len(li), sum(count[p] == best[p[1]] for p in li), sum(count[p] for p in li), H(g) if na else "") for na, nb, ng, li, g in every]


def test_alignment(spark, tmp_path):
    rng = random.Random(5)
    parts = ["straight", "unbelievably", " ", "  ", "\n", "\t", "é", "über", "日本語", "𝄞", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "ﬁ", "it's", "1234567", ".", "…", "​", "á", "\x00", "\xa0"]
    texts = [None, "", " ", "\n", "same text twice", "same text twice", "▁"] + parts + ["".join(rng.choice(parts[:13] + parts[15:]) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rows = [(None if k == 9 else k // 2, t, None, "s", 1) for k, t in enumerate(texts)]
    got = queries.op13_tokenizer_alignment(spark, saved(spark, rows, tmp_path)).collect()
    want = [(r[0], *x) for r, x in zip(rows, aligned(texts), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 100


def test_alignment_of_very_long_texts(spark):
    texts = [" " * 300_000 + "x", "ab\n" * 200_000, "word " * 200_000, "é" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "pair long, text string").withColumn("n", F.lit("clash"))
    found = tokenalign.alignment(docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"), id_col="pair")
    for r in found.collect():
        a, b = tokens(texts[r.pair])
        ends_a, ends_b = {e for *_, e in ranges(a)}, {e for *_, e in ranges(b)}
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))


def test_alignment_of_no_rows(spark, tmp_path):
    assert queries.op13_tokenizer_alignment(spark, saved(spark, [], tmp_path)).count() == 0


def test_both_sides_maxima(spark):
    docs = spark.createDataFrame([(0, "cat"), (1, "cat cat"), (2, "cats")], "doc_id long, text string")
    counts = tokenalign.pair_counts(tokenalign.documents_aligned(docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))).collect()
    for r in counts:
        assert r.best_a == (r["count"] == max(x["count"] for x in counts if x.a == r.a))
        assert r.best_b == (r["count"] == max(x["count"] for x in counts if x.b == r.b))


def test_a_large_bucket_with_few_strangers_is_not_squared(spark, monkeypatch):
    from fabula.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 4)
    for strangers, rows in ((2, 38 + 2 * 10), (11, None)):
        own = [(1, 5, k, 9, 100 + k if k < strangers else 7, k < strangers, 40) for k in range(40)]
        got = neardup._parted(spark.createDataFrame(own, "bucket long, slot byte, node long, n long, comp long, outlier boolean, size long")).collect()
        assert rows is None or len(got) == rows
        met = []
        for key in {(r.p, r.q) for r in got}:
            group = [r for r in got if (r.p, r.q) == key]
            for a in (r for r in group if r.outlier):
                for b in group:
                    if a.node != b.node and not (b.outlier and b.node < a.node) and not (key[1] > 0 and b.outlier) and not (key[1] < 0 and a.part == b.part):
                        met.append((a.node, b.node))
        assert sorted(met) == [(a, b) for a in range(strangers) for b in range(40) if a < b]
