"""Hand-made chapters, and a plain-Python model of the quote splitter and the casts."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from fabula.functions.spoken import spoken_text
from fabula.operators import evaluation, production
from fabula.operators import segments as S


def one(spark, text):
    return spark.createDataFrame([(1, text)], "chapter_id long, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("chapter_id", "id").collect()]


def test_quotes_of_all_kinds(spark):
    text = '“Go,” she said. «Non.»\n\nHe left. "Wait," said Mara, "please."\n“Unclosed line\nA 5" nail.'
    got = rows(S.split_segments(one(spark, text)), "kind", "original_text", "paragraph_index")
    assert got == [
        ("dialogue", "Go,", 0), ("narration", "she said.", 0), ("dialogue", "Non.", 0), ("narration", "He left.", 2), ("dialogue", "Wait,", 2),
        ("narration", "said Mara,", 2), ("dialogue", "please.", 2), ("dialogue", "Unclosed line", 3), ("narration", 'A 5" nail.', 4),
    ]


def walk(text):
    """Spans of a paragraph, letter by letter."""
    out, state, start, i = [], "narration", 0, 0
    shuts = lambda i: i > 0 and text[i - 1] in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,!?;…’'"
    while i < len(text):
        c = text[i]
        if state == "narration" and (c in "“«" or (c == '"' and not shuts(i))):
            if i > start:
                out.append((start, i, state, text[start:i]))
            state, start = "dialogue", i
        elif state == "dialogue" and (c in "”»" or (c == '"' and shuts(i))):
            out.append((start, i + 1, state, text[start + 1 : i]))
            state, start = "narration", i + 1
        i += 1
    if start < len(text):
        out.append((start, len(text), state, text[start + 1 :] if state == "dialogue" else text[start:]))
    return [(a, b, k, t.strip(" ")) for a, b, k, t in out if t.strip(" ")]


def test_splitter_against_a_walk(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab ."“”«»\'!é') for _ in range(rng.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "chapter_id long, text string")
    got = {}
    for r in S.quote_segments(df).orderBy("chapter_id", "id").collect():
        got.setdefault(r.chapter_id, []).append((r.char_offset_start, r.char_offset_end, r.kind, r.original_text))
    for k, t in enumerate(texts):
        assert got.get(k, []) == walk(t), t


def test_narration_is_merged_up_to_the_limit(spark):
    got = rows(S.split_segments(one(spark, "aaaa\nbbbb\ncccc\n“x”\ndd"), max_chars=9), "id", "original_text")
    assert got == [(1, "aaaa\nbbbb"), (2, "cccc"), (3, "x"), (4, "dd")]


def lines(spark, *parts):
    data = [(1, i, k, t, s, a, i) for i, (k, s, a, t) in enumerate(parts, 1)]
    return spark.createDataFrame(data, "chapter_id long, id int, kind string, original_text string, speaker string, attribution_source string, paragraph_index int")


def test_explicit_attribution_and_pronouns(spark):
    d, n = ("dialogue", "unknown", "none", "Hi."), lambda t: ("narration", "narrator", "none", t)
    got = rows(S.attribute_explicit(lines(spark, d, n("said Elena."), ("heading", "x", "none", "-"), d, n("He said to them. She asked."), d, n("Suddenly said the Old Bear quietly."))), "speaker", "attribution_source")
    assert got[0] == ("Elena", "explicit") and got[3] == ("unknown", "pronoun_male") and got[5] == ("unknown", "pronoun_male")
    alone = rows(S.attribute_explicit(lines(spark, n("The Captain whispered."), d)), "speaker", "attribution_source")
    assert alone[1] == ("Captain", "explicit")


def test_turns(spark):
    say = lambda who: ("dialogue", who, "explicit" if who != "unknown" else "none", "x")
    gap = ("narration", "narrator", "none", "y")
    who = lambda *p: [r[0] for r in rows(S.take_turns(lines(spark, *p)), "speaker")]
    assert who(say("A"), say("B"), say("unknown"), say("unknown")) == ["A", "B", "A", "B"]
    assert who(say("A"), say("unknown")) == ["A", "A"]
    assert who(say("A"), gap, gap, gap, say("unknown"))[-1] == "A"
    assert who(say("A"), gap, gap, gap, say("B"), gap, gap, gap, say("unknown"))[-1] == "unknown"


def test_spoken_text(spark):
    lexicon = F.create_map(F.lit("CIA"), F.lit("C I A"), F.lit("CIA man"), F.lit("spook"))
    cases = {
        "***": "", "a * b": "a * b", "[Quest] done": "Quest done", "HP: 0/5": "HP: zero out of five", "Effect: ???": "", "Tom & Ann": "Tom and Ann",
        "The CIA man and CIA": "The spook and C I A", "Item: [X] (rare, old)\nUses: 101": "Item: X, rare, old. Uses: 101", "one\n - - - \ntwo": "one. two", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", spoken_text(F.col("t"), lexicon).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases


def test_similarity_is_that_of_matching_blocks(spark):
    pairs = [("the cat sat", "the cat sat"), ("Bingley", "Bing Li"), ("", ""), ("a", ""), ("3 blind mice", "three blind mice"), ("x" * 150 + "y" * 150, "y" * 150 + "x" * 150)]
    got = evaluation.similarity(spark.createDataFrame(pairs, "expected string, heard string")).collect()
    assert [round(r.similarity, 6) for r in got[:5]] == [1.0, round(max(0.0, SequenceMatcher(None, "bingley", "bingli").ratio()), 6), 1.0, 0.0, 1.0]
    assert round(got[5].similarity, 6) == round(SequenceMatcher(None, pairs[5][0], pairs[5][1]).ratio(), 6)


def cast_model(people):
    """People (speaker, gender, voice or None) of one job."""
    mapping = {s: v for s, _, v in people if v}
    used = set(mapping.values())
    names, gender = [s for s, _, _ in people], {s: g for s, g, _ in people}
    if "narrator" in names and "narrator" not in mapping:
        mapping["narrator"] = "Ryan"
    used.add(mapping.get("narrator", "Ryan"))
    turn = {"male": 0, "female": 0}
    for s in sorted(names):
        if s in mapping:
            continue
        pool = {"male": production.MALE, "female": production.FEMALE}.get(gender[s])
        if not pool:
            free = [v for v in (*production.MALE, *production.FEMALE) if v not in used]
            v = "Eric" if "Eric" not in used else (free[0] if free else "Eric")
        else:
            v = None
            for _ in pool:
                c = pool[turn[gender[s]] % len(pool)]
                turn[gender[s]] += 1
                if c not in used:
                    v = c
                    break
            if v is None:
                v = pool[turn[gender[s]] % len(pool)]
                turn[gender[s]] += 1
        mapping[s] = v
        used.add(v)
    return mapping


def test_autocast_against_a_model(spark):
    rng = random.Random(8)
    jobs = {}
    for j in range(40):
        names = rng.sample(["narrator", *"ABCDEFGHIJKLMN"], rng.randint(1, 14))
        jobs[j] = [(n, rng.choice(["male", "female", "unknown"]), rng.choice([None] * 5 + ["Dylan", "Vivian"])) for n in names]
    df = spark.createDataFrame([(j, *p) for j, ps in jobs.items() for p in ps], "job_id long, speaker string, gender string, voice string")
    got = {}
    for r in production.autocast(df).collect():
        got.setdefault(r.job_id, {})[r.speaker] = r.voice
    for j, people in jobs.items():
        assert got[j] == cast_model(people), people


def test_hashed_cast_is_stable_and_distinct(spark):
    bank = spark.createDataFrame([(f"v{k}",) for k in range(6)] + [("Jason",), ("Ann",)], "voice string")
    df = spark.createDataFrame([(1, s) for s in ("Ann", "Bob", "Cy", "Di", "unknown", "Jason")], "job_id long, speaker string")
    got = {r.speaker: r.voice for r in production.hashed_cast(df, bank).collect()}
    again = {r.speaker: r.voice for r in production.hashed_cast(df.orderBy(F.desc("speaker")), bank).collect()}
    assert got == again and got["Ann"] == "Ann" and got["Jason"] == "Jason" and "unknown" not in got
    assert len(set(got.values())) == len(got)
