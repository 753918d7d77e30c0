"""Alias chains, lexicons, timelines by blocks, the stored index, crawl order: against plain models, on hard inputs."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fabula.functions.lexicon import Replacer, lexicon_of, replaced_by_row, replaced_in
from fabula.functions.spoken import spoken_text
from fabula.operators import corpus as C
from fabula.operators import crawl
from fabula.operators import production as P
from fabula.operators.fulltext import PhraseIndex

# aliases


def alias_model(lines, pairs):
    known = {w for w, n in lines.items() if " " not in w and n >= 5}
    owners = {}
    for (first, last), n in pairs.items():
        if n >= 3 and first in known:
            owners.setdefault(last, {})[first] = n
    step = {}
    for label in lines:
        words = label.split(" ")
        tails = [" ".join(words[k:]) for k in range(1, len(words))]
        if len(owners.get(label, {})) == 1 and label not in owners[label]:
            step[label] = next(iter(owners[label].items())) + ("surname",)
        elif any(t in lines and len(owners.get(t, {})) < 2 for t in tails):
            t = next(t for t in tails if t in lines and len(owners.get(t, {})) < 2)
            step[label] = (t, lines[t], "suffix")
        elif len(words) == 2 and words[0] in known:
            step[label] = (words[0], lines[words[0]], "full_name")
    out = set()
    for label, (target, evidence, reason) in step.items():
        seen = {label}
        while target in step and target not in seen:
            seen.add(target)
            target = step[target][0]
        if target != label:
            out.add((label, target, reason, evidence, lines[label]))
    return out


def test_alias_chains_against_a_walk(spark):
    rng = random.Random(11)
    names = ["Ada", "Bo", "Cy", "Dee", "Eli"]
    labels, pairs, want = [], [], set()
    for book in range(60):
        lines = {" ".join(rng.choice(names) for _ in range(rng.choice((1, 1, 2, 2, 3)))): rng.randint(1, 12) for _ in range(12)}
        told = {(rng.choice(names), rng.choice(names)): rng.randint(1, 6) for _ in range(6)}
        labels += [(book, k, n) for k, n in lines.items()]
        pairs += [(book, a, b, n) for (a, b), n in told.items() if n >= 3]
        want |= {(book, *x) for x in alias_model(lines, told)}
    labels, pairs = spark.createDataFrame(labels, "book_id int, label string, lines long"), spark.createDataFrame(pairs, "book_id int, first string, surname string, pairs long")
    got = C.derive_aliases(labels, pairs)
    assert {(r.book_id, r.alias, r.canonical, r.reason, r.evidence, r.lines) for r in got.collect()} == want and len(want) > 100
    assert C.derive_aliases(labels.limit(0), pairs.limit(0)).count() == 0
    assert C._ends({"a": "b", "b": "c", "c": "b", "d": "a", "e": "f"}) == {"a": "b", "b": "b", "c": "c", "d": "b", "e": "f"}


def test_a_long_chain_of_aliases():
    step = {f"n{k}": f"n{k + 1}" for k in range(200_000)}
    assert set(C._ends(step).values()) == {"n200000"}


def test_alias_plan_reads_each_table_once(spark):
    from fabula.catalog import corpora

    plan = corpora.alias_derive(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4


# lexicon


def by_hand(text, lexicon):
    for term in sorted((t for t in lexicon if t), key=lambda t: (-len(t), t)):
        text = re.sub(rf"\b{re.escape(term)}\b", lexicon[term], text)
    return text


def test_lexicon_equals_one_term_after_another():
    rng = random.Random(12)
    words = ["a", "b", "ab", "a b", "b c", "c", "c.", "-a", "a-b", "é", "b a b", "", "1"]
    for _ in range(4000):
        lexicon = {rng.choice(words): rng.choice([*words, "x y", r"\\z", "", "a a"]) for _ in range(rng.randrange(1, 7))}
        text = "".join(rng.choice([*words, " ", " ", "-", "."]) for _ in range(rng.randrange(0, 14)))
        assert Replacer(lexicon)(text) == by_hand(text, lexicon), (lexicon, text)


def test_ten_thousand_terms_cost_little_more_than_ten(spark):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(400)) for _ in range(300)]
    few, many = ({f"w{k}": f"W{k}" for k in range(n)} for n in (10, 10_000))
    took = {}
    for n, lexicon in ((10, few), (10_000, many)):
        replacer = Replacer(lexicon)
        replacer("w1")
        began = time.time()
        got = [replacer(t) for t in texts]
        took[n] = time.time() - began
        assert got == [re.sub(r"\bw(\d+)\b", lambda m, n=n: ("W" if int(m[1]) < n else "w") + m[1], t) for t in texts]
    assert took[10_000] < 20 * took[10] + 0.5
    long = "w1 plain " * 120_000
    assert Replacer(many)(long) == "W1 plain " * 120_000


def test_lexicons_by_column_and_table(spark):
    df = spark.createDataFrame([("the CIA man", {"CIA": "C I A"}), ("the CIA", None), (None, {"x": "y"}), ("", {"x": "y"})], "t string, m map<string,string>")
    assert [r.t for r in replaced_by_row(df, "t", "m").collect()] == ["the C I A man", "the CIA", None, ""]
    assert [(r.t, r.m) for r in replaced_in(df, "t", {"the": "a"}).collect()][0] == ("a CIA man", {"CIA": "C I A"})
    table = spark.createDataFrame([("a", "x"), ("a", "w"), (None, "q"), ("b", None)], "term string, said string")
    assert lexicon_of(table) == {"a": "w"}
    with pytest.raises(ValueError):
        lexicon_of(spark.range(10).select(F.col("id").cast("string").alias("term"), F.lit("x").alias("said")), most=9)


def test_long_blanks_and_signs_take_linear_time(spark):
    for text in ("word" + " " * 400_000 + ". end", "( " * 100_000, ", " * 100_000 + "x", "Item: " + "(a) " * 50_000, "& " * 100_000 + "y"):
        began = time.time()
        spark.createDataFrame([(text,)], "t string").select(spoken_text(F.col("t"))).collect()
        assert time.time() - began < 30, text[:10]


# timeline


def test_timeline_over_many_ranges(spark, monkeypatch):
    rng = random.Random(14)
    clips = [(j, i, rng.choice((0, 0, 0, 300, None)), rng.choice((0, 5, 10, 40, 500))) for j in range(4) for i in range(30 if j == 2 else 700)]
    want, totals, at, last = {}, {}, 0, None
    for j, i, pause, long in clips:
        at = 0 if j != last else at
        last = j
        start = at + pause if pause else at - 50 if at > 50 else at
        at = start + long
        want[j, i], totals[j] = start, at
    df = spark.createDataFrame(rng.sample(clips, len(clips)), "job_id int, id int, pause_before_ms int, duration_ms int").repartition(8)
    seen = []
    keep = P.kept
    monkeypatch.setattr(P, "kept", lambda d, name: (seen.append(keep(d, name)) or seen[-1]))
    for size in ("64m", "2k"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        got = P.timeline(df).collect()
        assert {(r.job_id, r.id): r.start_ms for r in got} == want and {r.job_id: r.total_ms for r in got} == totals
    for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
        spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert seen[-1].select("job_id", "range").distinct().count() > 4


def test_block_functions_compose():
    rng = random.Random(15)
    for _ in range(300):
        clips = [(rng.choice((0, 0, 20)), rng.choice((0, 1, 7, 30, 90))) for _ in range(12)]
        pieces = [(P.ENDLESS, 0)]
        for pause, long in clips:
            pieces = P._lengths_after(pieces, pause, long, 50)
        for before in range(0, 400, 3):
            at = before
            for pause, long in clips:
                at = (at + pause if pause else at - 50 if at > 50 else at) + long
            assert at == before + next(add for limit, add in pieces if before <= limit)


def test_assembly_order(spark):
    seg = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)], "job_id int, id int")
    reused, rendered = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 9, "z"), (2, 1, None)], "job_id int, id int, clip string"), spark.createDataFrame([(1, 3, "n"), (1, 4, "d"), (1, 4, "e")], "job_id int, id int, clip string")
    got = P.assembly_order(seg, reused, rendered).orderBy("job_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, "a", False), (1, 3, 2, "n", True), (1, 4, 3, "e", True)]


# full text


def test_index_is_renewed_by_chapter(spark, tmp_path):
    rng = random.Random(16)
    index = PhraseIndex(spark, str(tmp_path / "index"), buckets=8)
    assert index.search("a b").count() == 0
    schema = "book_id int, chapter_number long, chapter_seq int, text string"
    make = lambda chapters: [(1, c, s, " ".join(rng.choice(["of", "the", "The", "sea,", "é"]) for _ in range(30))) for c in chapters for s in range(5)]
    first, second = make(range(6)), make((2, 4)) + [(1, 5, 0, None)]
    rows = {r[:3]: r[3] for r in first}
    for load in (first, second):
        index.renew(spark.createDataFrame(load, schema))
        rows = {k: t for k, t in rows.items() if (k[0], k[1]) not in {(r[0], r[1]) for r in load}} | {r[:3]: r[3] for r in load}
        for phrase in ("of the", "the the the", "sea of", "É the", "missing the", "the"):
            words = re.findall(r"\w+", phrase.lower())
            want = {}
            for k, t in rows.items():
                own = re.findall(r"\w+", (t or "").lower())
                n = sum(own[p : p + len(words)] == words for p in range(len(own)))
                if n:
                    want[k] = n
            assert {(r.book_id, r.chapter_number, r.chapter_seq): r.hits for r in index.search(phrase).collect()} == want, phrase
    assert index.generation() == 2 and index.search(" ,").count() == 0
    plan = index.postings(["of"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "token" in plan.split("PushedFilters")[1][:200]


# crawl


def test_reading_order(spark):
    rng = random.Random(17)
    pages = list(range(120))
    rng.shuffle(pages)
    links = [(a, b) for a, b in zip(pages[:60], pages[1:61], strict=True)] + [(pages[60], 999), (pages[61], pages[30]), (pages[62], pages[61])]
    ring = pages[70:77]
    links += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(pages[80], ring[2]), (pages[81], pages[80]), (pages[90], pages[90]), (pages[100], None), (pages[100], None), (None, 5)]
    got = {r.page: (r.last, r.left, r.place, r.on_ring) for r in crawl.reading_order(spark.createDataFrame(links, "page long, next long")).collect()}
    for k, p in enumerate(pages[:61]):
        assert got[p] == (pages[60], 60 - k, k + 1, False)
    assert got[pages[61]] == (pages[60], 31, 30, False) and got[pages[62]] == (pages[60], 32, 29, False) and got[pages[100]] == (pages[100], 0, 1, False)
    assert all(got[p] == (None, None, None, True) for p in [*ring, pages[90]]) and all(got[p] == (None, None, None, False) for p in pages[80:82])
    assert len(got) == len({a for a, _ in links if a is not None})
    assert crawl.reading_order(spark.createDataFrame([], "page string, next string")).count() == 0


def test_many_jobs_share_a_call(spark):
    df = spark.createDataFrame([(job, k, 10 * (k % 2), job + k) for job in range(300) for k in range(3)], "job_id int, id int, pause_before_ms int, duration_ms int")
    out = P.timeline(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert len({(r.job_id, r.total_ms) for r in out.collect()}) == 300
