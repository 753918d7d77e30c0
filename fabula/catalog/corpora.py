"""Queries of the corpus and selection operators.

The corpus is made from ``conversations``: a book for each remainder of conv_id by 3, a chapter for each
conversation, a segment for each turn, with labels and alignment computed from lengths.  ``PRELUDE`` builds
the same in SQL; expressions in both are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.operators import corpus as C
from fabula.operators import selection as L
from fabula.sources.tables import kept

LABELS = ("Edwin", "Tobias", "Training Tobias", "Clara Winslow", "Clara", "Winslow", "unknown", "Marlow", "Edwin Marlow")
PICK = "(conv_id * 4 + turn * 2) % 9"
SPEAKER = "case when role = 'system' then 'narrator' " + " ".join(f"when {PICK} = {k} then '{n}'" for k, n in enumerate(LABELS)) + " end"
KIND = "case when role = 'system' then 'narration' when turn % 6 = 5 then 'heading' else 'dialogue' end"
ALIGNED = "(conv_id + turn) % 11 <> 0"
START = "cast(turn * 20 as double) + 0.25"
LONG = "cast(length(text) % 150 as double) / 10.0"
SCORE = "cast((length(text) * 7 + turn * 13) % 100 as double) / 100.0"
MALE, FEMALE = "cast((conv_id * 7) % 5 as bigint)", "cast((conv_id * 3 + 1) % 4 as bigint)"

PRELUDE = f"""
WITH raw AS (SELECT conv_id % 3 + 1 AS book_id, conv_id AS chapter_number, turn, {KIND} AS kind, {SPEAKER} AS speaker, coalesce(text, '') AS text,
  CASE WHEN {ALIGNED} THEN {START} END AS s, CASE WHEN {ALIGNED} THEN {START} + {LONG} END AS e, CASE WHEN {ALIGNED} THEN {SCORE} END AS score, length(text) % 37 + 1 AS words FROM conversations),
segments AS (SELECT book_id, chapter_number, row_number() OVER w AS chapter_seq, chapter_number * 100000 + row_number() OVER w AS book_seq, kind, speaker, text,
  len(regexp_extract_all(text, '[A-Za-z'']+')) AS word_count, round(s + 1.5, 3) AS audio_start_s, round(e + 1.5, 3) AS audio_end_s, round(e - s, 3) AS duration_s,
  score AS align_score, CASE WHEN s IS NOT NULL THEN words END AS align_words FROM raw WINDOW w AS (PARTITION BY book_id, chapter_number ORDER BY turn)),
votes AS (SELECT DISTINCT conv_id % 3 + 1 AS book_id, conv_id AS chapter_number, {SPEAKER} AS name, {MALE} AS male_votes, {FEMALE} AS female_votes FROM conversations),
labels AS (SELECT book_id, speaker AS label, count(*) AS lines FROM segments WHERE kind <> 'heading' AND speaker NOT IN ('narrator', 'unknown') GROUP BY 1, 2)
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cols = {"book_id": "conv_id % 3 + 1", "chapter_number": "conv_id", "id": "turn", "kind": KIND, "speaker": SPEAKER, "text": "coalesce(text, '')", "ok": ALIGNED, "s": START, "long": LONG, "score": SCORE}
    return t.select(*[F.expr(e).alias(c) for c, e in cols.items()], F.expr("length(text) % 37 + 1").alias("words"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir)
    spans = r.filter("ok").select(
        "book_id", "chapter_number", "id", F.col("s").alias("start"), (F.col("s") + F.col("long")).alias("end"), F.col("score").alias("mean_score"), "words", F.lit(1.5).alias("offset")
    )
    return C.load_segments(r.select("book_id", "chapter_number", "id", "kind", "speaker", "text"), spans)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cols = {"book_id": "conv_id % 3 + 1", "chapter_number": "conv_id", "name": SPEAKER, "male_votes": MALE, "female_votes": FEMALE}
    return t.select(*[F.expr(e).alias(c) for c, e in cols.items()]).distinct()


def registry(spark: SparkSession) -> DataFrame:
    rows = [(1, "Tobias", "female", 0.9), (1, "Clara", "male", 0.4), (2, "Edwin", "unknown", 0.99), (2, "Winslow", "female", 0.6), (3, "Marlow", "male", 0.75)]
    return spark.createDataFrame(rows, "book_id long, name string, gender string, confidence double")


REGISTRY = "(VALUES (1, 'Tobias', 'female', 0.9), (1, 'Clara', 'male', 0.4), (2, 'Edwin', 'unknown', 0.99), (2, 'Winslow', 'female', 0.6), (3, 'Marlow', 'male', 0.75)) r(book_id, name, gender, confidence)"

#: Prose in which surnames follow first names, a number of times that differs by customer.
PROSE = "case c_custkey % 5 when 0 then 'When Edwin Marlow came' when 1 then 'Then Clara Winslow and Tobias Winslow sat' when 2 then 'So Tobias Quillfeather said' when 3 then 'and Edwin Thrushcombe left' else 'with Osbert Plinkett' end"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.expr("c_custkey % 3 + 1").alias("book_id"), F.expr(PROSE).alias("text"))


OWNERS = f"""
, pairs AS (SELECT book_id, split_part(p, ' ', 1) AS first, split_part(p, ' ', 2) AS surname, count(*) AS pairs FROM (
    SELECT c_custkey % 3 + 1 AS book_id, unnest(regexp_extract_all({PROSE}, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')) AS p FROM customer) GROUP BY ALL),
owners AS (SELECT p.*, count(*) OVER (PARTITION BY p.book_id, surname) > 1 AS ambiguous FROM pairs p SEMI JOIN (SELECT book_id, label AS first FROM labels WHERE lines >= 5 AND label NOT LIKE '% %') l USING (book_id, first) WHERE pairs >= 3)
"""
DERIVED = OWNERS + """
, tails AS (SELECT l.book_id, l.label, k AS cut, array_to_string(string_split(l.label, ' ')[k:], ' ') AS tail FROM labels l, (SELECT unnest([2, 3, 4]) AS k) WHERE k <= len(string_split(l.label, ' '))),
proposals AS (
  SELECT o.book_id, surname AS label, first AS canonical, pairs AS evidence, 1 AS rank, 'surname' AS reason FROM owners o SEMI JOIN labels l ON l.book_id = o.book_id AND l.label = o.surname WHERE NOT ambiguous AND first <> surname
  UNION ALL SELECT t.book_id, t.label, min_by(tail, cut), min_by(h.lines, cut), 2, 'suffix' FROM tails t JOIN labels h ON h.book_id = t.book_id AND h.label = t.tail
    ANTI JOIN (SELECT DISTINCT book_id, surname FROM owners WHERE ambiguous) a ON a.book_id = t.book_id AND a.surname = t.tail GROUP BY 1, 2
  UNION ALL SELECT l.book_id, l.label, h.label, h.lines, 3, 'full_name' FROM labels l JOIN labels h ON h.book_id = l.book_id AND h.label = split_part(l.label, ' ', 1) AND h.lines >= 5 WHERE len(string_split(l.label, ' ')) = 2),
chosen AS (SELECT * FROM proposals QUALIFY row_number() OVER (PARTITION BY book_id, label ORDER BY rank) = 1),
c2 AS (SELECT c.*, coalesce(d.canonical, c.canonical) AS c1 FROM chosen c LEFT JOIN chosen d ON d.book_id = c.book_id AND d.label = c.canonical),
c3 AS (SELECT c.*, coalesce(d.canonical, c.c1) AS target FROM c2 c LEFT JOIN chosen d ON d.book_id = c.book_id AND d.label = c.c1),
aliases AS (SELECT c.book_id, c.label AS alias, c.target AS canonical, c.reason, CAST(c.evidence AS BIGINT) AS evidence, l.lines FROM c3 c JOIN labels l USING (book_id, label) WHERE target <> label)
"""


def _owners(spark, sf_dir):
    return C.surname_owners(prose(spark, sf_dir), C.label_counts(segments(spark, sf_dir)))


def _aliases(spark, sf_dir):
    return C.derive_aliases(C.label_counts(segments(spark, sf_dir)), C.name_pairs(prose(spark, sf_dir)))


def load_segments_words(spark, sf_dir):
    return segments(spark, sf_dir)


def _words(spark, sf_dir):
    """A word for each space-separated part of every turn."""
    r = raw(spark, sf_dir).select("book_id", "chapter_number", F.col("id").alias("segment_id"), F.posexplode(F.split("text", " ")).alias("idx", "word"))
    start = F.col("segment_id") * 100.0 + F.col("idx") * 0.5
    return r.select("book_id", "chapter_number", "segment_id", "idx", start.alias("start"), (start + F.length("word") * 0.05).alias("end"), (F.pmod(F.length("word") * 7 + F.col("idx") * 3, F.lit(97)) / F.lit(97.0)).alias("score"))


WORDS = """
WITH r AS (SELECT conv_id % 3 + 1 AS book_id, conv_id AS chapter_number, turn AS segment_id, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
words AS (SELECT book_id, chapter_number, segment_id, i AS idx, segment_id * 100.0::DOUBLE + i * 0.5::DOUBLE AS start, segment_id * 100.0::DOUBLE + i * 0.5::DOUBLE + length(w[i + 1]) * 0.05::DOUBLE AS stop,
  ((length(w[i + 1]) * 7 + i * 3) % 97) / 97.0::DOUBLE AS score FROM (SELECT *, unnest(range(0, len(w))) AS i FROM r)),
spans AS (SELECT book_id, chapter_number, segment_id, min_by(start, idx) AS start, max_by(stop, idx) AS "end", count(*) AS words, round(avg(score), 3) AS mean_score,
  round(max_by(stop, idx) - min_by(start, idx), 3) AS duration FROM words GROUP BY 1, 2, 3)
"""


def align_spans(spark, sf_dir):
    return C.align_spans(_words(spark, sf_dir))


def _health(w):
    d = w.groupBy("book_id", "chapter_number").agg((F.max("segment_id") * 100.0 + 119.37).alias("audio_s"))
    return C.align_health(w, d)


def align_health(spark, sf_dir):
    return _health(_words(spark, sf_dir))


def rebuild_characters(spark, sf_dir):
    return C.rebuild_characters(segments(spark, sf_dir), votes(spark, sf_dir))


def gender_override(spark, sf_dir):
    return C.rebuild_characters(segments(spark, sf_dir), votes(spark, sf_dir), registry(spark)).select("book_id", "name", "gender")


def annotation_carry(spark, sf_dir):
    """A new load changes the text of every fifth segment; annotations come from ``labels``."""
    old = segments(spark, sf_dir)
    new = old.withColumn("text", F.when(F.col("book_seq") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.expr("doc_id % 100").alias("chapter_number"), F.expr("doc_id % 4 + 1").cast("int").alias("chapter_seq"), F.lit("quality").alias("key"), F.col("quality").alias("value"))
    meta = marks.distinct().join(old.select(*C.SEGMENT_KEY), ["chapter_number", "chapter_seq"]).select(*C.SEGMENT_KEY, "key", "value")
    return C.carried_annotations(meta, old, new)


def upsert_books(spark, sf_dir):
    """Suppliers stand for stored books, the same and more customers for a new load."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr("concat('b', s_suppkey)").alias("slug"), F.col("s_name").alias("title"), F.lit("old").alias("author"), F.lit("a.m4b").alias("audio_source"), F.lit("a.epub").alias("epub_source"), F.col("s_acctbal").alias("audio_duration_s"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 7 = 0").select(F.expr("concat('b', c_custkey)").alias("slug"), F.col("c_name").alias("title"), F.lit("new").alias("author"), F.lit("b.m4b").alias("audio_source"), F.lit("b.epub").alias("epub_source"), F.col("c_acctbal").alias("audio_duration_s"))
    return C.upsert_books(s, c)


def replace_chapters(spark, sf_dir):
    old = segments(spark, sf_dir)
    new = old.filter("chapter_number % 4 = 0 and chapter_seq <= 2")
    out = C.replaced(old, new)
    return out.groupBy("book_id", "chapter_number").agg(F.count(F.lit(1)).alias("segments"))


def surname_owners(spark, sf_dir):
    return _owners(spark, sf_dir)


def alias_derive(spark, sf_dir):
    return _aliases(spark, sf_dir)


def alias_apply(spark, sf_dir):
    return C.apply_aliases(segments(spark, sf_dir), _aliases(spark, sf_dir)).select(*C.SEGMENT_KEY, "speaker", "speaker_raw")


def label_stats_having(spark, sf_dir):
    return C.label_stats(segments(spark, sf_dir), 10)


def registry_guard(spark, sf_dir):
    """Every pair of labels of a book is proposed as a merge, and each label with one that is no label or none."""
    labels = kept(C.label_counts(segments(spark, sf_dir)), "labels")
    pairs = labels.select("book_id", F.col("label").alias("name")).join(labels.select("book_id", F.col("label").alias("canonical")), "book_id")
    odd = labels.select("book_id", F.col("label").alias("name")).withColumn("canonical", F.when(F.length("name") % 2 == 0, "Nobody"))
    return C.guard_verdicts(pairs.unionByName(odd), labels, C.surname_owners(prose(spark, sf_dir), labels))


def fts_phrase(spark, sf_dir):
    return C.phrase_hits(C.text_index(segments(spark, sf_dir)), ["of", "the"])


def evidence_bundle(spark, sf_dir):
    out = C.evidence(segments(spark, sf_dir), votes(spark, sf_dir))
    chars = lambda c: F.coalesce(F.array_join(F.transform(c, lambda t: F.length(t).cast("string")), ","), F.lit(""))
    return out.select("book_id", "name", "lines", "first_ch", "last_ch", "male_votes", "female_votes", chars("dialogue").alias("dialogue"))


def corpus_stats(spark, sf_dir):
    return C.corpus_stats(segments(spark, sf_dir))


def top_speakers(spark, sf_dir):
    return C.top_speakers(segments(spark, sf_dir), 5)


def marker_diff(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"))
    m = n.filter("number % 5 <> 1").withColumn("title", F.when(F.col("number") % 4 == 0, F.concat("title", F.lit(" II"))).otherwise(F.concat(F.lower("title"), F.lit("!"))))
    return C.marker_differences(m, n.filter("number % 6 <> 2"))


def chapter_spec(spark, sf_dir):
    s = segments(spark, sf_dir).select(F.col("chapter_number").alias("number")).distinct()
    return C.chosen_chapters(s, "1,4-9, 70-72,999")


def clip_select(spark, sf_dir):
    return L.select_clips(segments(spark, sf_dir), 1, kind="dialogue", min_score=0.3, min_words=5, min_duration=2.0).select("book_seq", "speaker", "duration_s")


def clip_spread(spark, sf_dir):
    return L.select_clips(segments(spark, sf_dir), 2, limit=17, spread=True).select("book_seq", "speaker")


def clip_manifest(spark, sf_dir):
    return L.clip_manifest(L.select_clips(segments(spark, sf_dir), 3))


BANK = dict(min_score=0.3, min_words=3, low=2.0, high=14.0)


def voicebank(spark, sf_dir):
    return L.voice_bank(segments(spark, sf_dir), **BANK)


def training_budget(spark, sf_dir):
    return L.training_set(segments(spark, sf_dir), 400.0, min_score=0.2).select("book_id", "book_seq", "duration_s", "total_s")


def zscore_profile(spark, sf_dir):
    m = segments(spark, sf_dir).filter("audio_start_s is not null").select("book_id", "book_seq", "duration_s", "align_score", F.col("word_count").cast("double").alias("words"))
    return L.z_profile(m, ["duration_s", "align_score", "words"]).select("book_id", "book_seq", "subdued", "intense")


def best_clip_per_emotion(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("emotion", F.expr("case book_seq % 3 when 0 then 'happy' when 1 then 'sad' else 'neutral' end"))
    return L.best_clip_per_emotion(s.filter("audio_start_s is not null").withColumn("book_seq", F.col("book_seq")))


QUERIES = {
    f.__name__: f
    for f in (
        load_segments_words, align_spans, align_health, rebuild_characters, gender_override, annotation_carry, upsert_books, replace_chapters, surname_owners, alias_derive,
        alias_apply, label_stats_having, registry_guard, fts_phrase, evidence_bundle, corpus_stats, top_speakers, marker_diff, chapter_spec, clip_select, clip_spread,
        clip_manifest, voicebank, training_budget, zscore_profile, best_clip_per_emotion,
    )
}

CHARACTERS = """
, tally AS (SELECT book_id, name, sum(male_votes) AS m, sum(female_votes) AS f FROM votes GROUP BY 1, 2),
characters AS (SELECT l.book_id, l.label AS name, l.lines AS segment_count, CAST(coalesce(m, 0) AS BIGINT) AS male_votes, CAST(coalesce(f, 0) AS BIGINT) AS female_votes,
  CASE WHEN coalesce(m, 0) > coalesce(f, 0) THEN 'male' WHEN coalesce(f, 0) > coalesce(m, 0) THEN 'female' ELSE 'unknown' END AS gender
  FROM labels l LEFT JOIN tally t ON t.book_id = l.book_id AND t.name = l.label)
"""
SPREAD = "SELECT *, row_number() OVER g - 1 AS p, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows}) WINDOW g AS (PARTITION BY {by} ORDER BY book_seq)"
TAKEN = "n <= {k} OR p IN (SELECT floor(i * (n / {k}.0::DOUBLE)) FROM range(0, {k}) t(i))"
BANKED = "SELECT * FROM segments WHERE ((kind = 'dialogue' AND speaker NOT IN ('unknown', 'narrator')) OR (kind = 'narration' AND speaker = 'narrator')) AND audio_start_s IS NOT NULL AND align_score >= 0.3 AND word_count >= 3 AND duration_s BETWEEN 2.0 AND 14.0"

ORACLE_SQL = {
    "load_segments_words": PRELUDE + "SELECT * REPLACE (CAST(chapter_seq AS INTEGER) AS chapter_seq, CAST(word_count AS INTEGER) AS word_count, CAST(align_words AS INTEGER) AS align_words) FROM segments",
    "align_spans": WORDS + "SELECT * FROM spans",
    "align_health": WORDS + """
, a AS (SELECT book_id, chapter_number, count(*) AS word_count, round(avg(score), 4) AS mean_score, count(*) FILTER (score < 0.5) AS low_confidence_words, max(segment_id) * 100.0::DOUBLE + 119.37::DOUBLE AS d FROM words GROUP BY 1, 2),
b AS (SELECT book_id, chapter_number, min(start) AS f, max_by("end", start) AS l, sum(duration) AS s FROM spans GROUP BY 1, 2)
SELECT book_id, chapter_number, word_count, mean_score, low_confidence_words, round((l - f) / d, 4) AS coverage, round(s / d, 4) AS speech_ratio, round(f, 2) AS leading_silence_s, round(d - l, 2) AS trailing_silence_s
FROM a JOIN b USING (book_id, chapter_number)""",
    "rebuild_characters": PRELUDE + CHARACTERS + "SELECT * FROM characters",
    "gender_override": PRELUDE + CHARACTERS + f"SELECT c.book_id, c.name, CASE WHEN r.gender IN ('male', 'female') AND r.confidence >= 0.6 THEN r.gender ELSE c.gender END AS gender FROM characters c LEFT JOIN {REGISTRY} ON r.book_id = c.book_id AND r.name = c.name",
    "annotation_carry": PRELUDE + """
, marks AS (SELECT DISTINCT doc_id % 100 AS chapter_number, doc_id % 4 + 1 AS chapter_seq, 'quality' AS key, quality AS value FROM "labels_table")
SELECT s.book_id, s.chapter_number, CAST(s.chapter_seq AS INTEGER) AS chapter_seq, m.key, m.value FROM marks m JOIN segments s USING (chapter_number, chapter_seq) WHERE s.book_seq % 5 <> 0""".replace('"labels_table"', "main.labels"),
    "upsert_books": """
SELECT coalesce(o.slug, n.slug) AS slug, coalesce(n.title, o.title) AS title, coalesce(o.author, n.author) AS author, coalesce(n.a, o.a) AS audio_source, coalesce(n.e, o.e) AS epub_source,
  CASE WHEN n.slug IS NOT NULL THEN n.d ELSE o.d END AS audio_duration_s
FROM (SELECT 'b' || s_suppkey AS slug, s_name AS title, 'old' AS author, 'a.m4b' AS a, 'a.epub' AS e, s_acctbal AS d FROM supplier) o
FULL JOIN (SELECT 'b' || c_custkey AS slug, c_name AS title, 'new' AS author, 'b.m4b' AS a, 'b.epub' AS e, c_acctbal AS d FROM customer WHERE c_custkey % 7 = 0) n ON o.slug = n.slug""",
    "replace_chapters": PRELUDE + "SELECT book_id, chapter_number, count(*) AS segments FROM segments WHERE chapter_number % 4 <> 0 OR chapter_seq <= 2 GROUP BY 1, 2",
    "surname_owners": PRELUDE + OWNERS + "SELECT * FROM owners",
    "alias_derive": PRELUDE + DERIVED + "SELECT * FROM aliases",
    "alias_apply": PRELUDE + DERIVED + "SELECT s.book_id, s.chapter_number, CAST(s.chapter_seq AS INTEGER) AS chapter_seq, coalesce(a.canonical, s.speaker) AS speaker, a.alias AS speaker_raw FROM segments s LEFT JOIN aliases a ON a.book_id = s.book_id AND a.alias = s.speaker",
    "label_stats_having": PRELUDE + "SELECT book_id, speaker AS name, count(*) AS lines, min(chapter_number) AS first_ch, max(chapter_number) AS last_ch FROM segments WHERE kind = 'dialogue' AND speaker NOT IN ('narrator', 'unknown') GROUP BY 1, 2 HAVING count(*) >= 10",
    "registry_guard": PRELUDE + OWNERS + """
, v AS (SELECT a.book_id, a.label AS name, b.label AS canonical FROM labels a JOIN labels b USING (book_id) UNION ALL SELECT book_id, label, CASE WHEN length(label) % 2 = 0 THEN 'Nobody' END FROM labels),
amb AS (SELECT DISTINCT book_id, surname FROM owners WHERE ambiguous),
j AS (SELECT v.*, string_split(v.name, ' ') AS w, k.label IS NOT NULL AS known, o.first AS owner, x.surname IS NOT NULL AS bad_name, y.surname IS NOT NULL AS bad_last, z.surname IS NOT NULL AS bad_target FROM v
  LEFT JOIN labels k ON k.book_id = v.book_id AND k.label = v.canonical LEFT JOIN owners o ON o.book_id = v.book_id AND o.surname = v.name AND NOT o.ambiguous
  LEFT JOIN amb x ON x.book_id = v.book_id AND x.surname = v.name LEFT JOIN amb y ON y.book_id = v.book_id AND y.surname = string_split(v.name, ' ')[-1] LEFT JOIN amb z ON z.book_id = v.book_id AND z.surname = v.canonical),
k AS (SELECT *, CASE WHEN canonical IS NULL THEN 'proposed' WHEN canonical = name THEN 'vetoed:self' WHEN NOT known THEN 'vetoed:unknown-target'
  WHEN len(w) > 1 AND list_contains(w, canonical) AND NOT bad_target THEN 'merge' WHEN bad_name OR (len(w) > 1 AND bad_last) THEN 'vetoed:shared-surname' WHEN owner = canonical THEN 'merge' ELSE 'vetoed:unsupported' END AS verdict FROM j)
SELECT book_id, name, CASE WHEN verdict <> 'vetoed:self' THEN canonical END AS canonical, verdict FROM k""",
    "fts_phrase": PRELUDE + r"""
, tok AS (SELECT book_id, chapter_number, chapter_seq, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM segments))
SELECT a.book_id, a.chapter_number, CAST(a.chapter_seq AS INTEGER) AS chapter_seq, count(*) AS hits FROM tok a JOIN tok b USING (book_id, chapter_number, chapter_seq) WHERE a.token = 'of' AND b.token = 'the' AND b.pos = a.pos + 1 GROUP BY ALL""",
    "evidence_bundle": PRELUDE + CHARACTERS + """
, stats AS (SELECT book_id, speaker AS name, count(*) AS lines, min(chapter_number) AS first_ch, max(chapter_number) AS last_ch FROM segments WHERE kind = 'dialogue' AND speaker NOT IN ('narrator', 'unknown') GROUP BY 1, 2 HAVING count(*) >= 2),
said AS (SELECT book_id, speaker AS name, string_agg(CAST(least(length(text), 260) AS VARCHAR), ',' ORDER BY book_seq) AS dialogue FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, speaker ORDER BY book_seq) AS r FROM segments WHERE kind = 'dialogue' AND word_count BETWEEN 4 AND 40) WHERE r <= 4 GROUP BY 1, 2)
SELECT s.*, CAST(coalesce(t.m, 0) AS BIGINT) AS male_votes, CAST(coalesce(t.f, 0) AS BIGINT) AS female_votes, coalesce(d.dialogue, '') AS dialogue FROM stats s LEFT JOIN tally t USING (book_id, name) LEFT JOIN said d USING (book_id, name)""",
    "corpus_stats": PRELUDE + "SELECT book_id, count(DISTINCT chapter_number) AS chapters, count(*) AS segments, count(audio_start_s) AS aligned, round(sum(duration_s), 3) AS seconds, round(avg(align_score), 4) AS mean_score FROM segments GROUP BY 1",
    "top_speakers": PRELUDE + """
SELECT book_id, speaker, lines, minutes, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY lines DESC, speaker) AS rank FROM (
  SELECT book_id, speaker, count(*) AS lines, round(coalesce(sum(duration_s), 0) / 60, 2) AS minutes, round(avg(align_score), 3) AS score FROM segments GROUP BY 1, 2)) WHERE rank <= 5""",
    "marker_diff": """
SELECT * FROM (SELECT coalesce(m.n, t.n_nationkey) AS number, m.title AS marker_title, t.n_name AS text_title,
  CASE WHEN t.n_name IS NULL THEN 'missing text' WHEN m.title IS NULL THEN 'extra text' WHEN regexp_replace(lower(m.title), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(t.n_name), '[^a-z0-9]', '', 'g') THEN 'title differs' END AS state
FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' II' ELSE lower(n_name) || '!' END AS title FROM nation WHERE n_nationkey % 5 <> 1) m
FULL JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 2) t ON t.n_nationkey = m.n) WHERE state IS NOT NULL""",
    "chapter_spec": "SELECT DISTINCT conv_id AS number FROM conversations WHERE conv_id = 1 OR conv_id BETWEEN 4 AND 9 OR conv_id BETWEEN 70 AND 72 OR conv_id = 999",
    "clip_select": PRELUDE + "SELECT book_seq, speaker, duration_s FROM segments WHERE book_id = 1 AND audio_start_s IS NOT NULL AND kind = 'dialogue' AND align_score >= 0.3 AND word_count >= 5 AND duration_s >= 2.0",
    "clip_spread": PRELUDE + f"SELECT book_seq, speaker FROM ({SPREAD.format(by='book_id', rows='SELECT * FROM segments WHERE book_id = 2 AND audio_start_s IS NOT NULL')}) WHERE {TAKEN.format(k=17)}",
    "clip_manifest": PRELUDE + """
SELECT replace(replace(speaker, ' ', '_'), '/', '_') || '_ch' || lpad(CAST(chapter_number AS VARCHAR), 3, '0') || '_seg' || lpad(CAST(chapter_seq AS VARCHAR), 4, '0') || '.wav' AS file, speaker, chapter_number,
  CAST(chapter_seq AS INTEGER) AS chapter_seq, round(greatest(0.0, audio_start_s - 0.12), 3) AS cut_start_s, round(audio_end_s + 0.12, 3) AS cut_end_s, duration_s, align_score FROM segments WHERE book_id = 3 AND audio_start_s IS NOT NULL""",
    "voicebank": PRELUDE + f"""
, taken AS (SELECT * FROM ({SPREAD.format(by='book_id, speaker', rows=BANKED)}) WHERE {TAKEN.format(k=3)})
SELECT book_id, speaker, CAST(clip AS INTEGER) AS clip, replace(speaker, ' ', '_') || '_' || lpad(CAST(clip AS VARCHAR), 2, '0') || '.wav' AS file, chapter_number, CAST(chapter_seq AS INTEGER) AS chapter_seq, duration_s
FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY book_id, speaker ORDER BY book_seq) AS clip, count(*) OVER (PARTITION BY book_id, speaker) AS n FROM taken) WHERE n >= 2""",
    "training_budget": PRELUDE + """
SELECT * FROM (SELECT book_id, book_seq, duration_s, round(sum(duration_s) OVER (ORDER BY book_id, book_seq), 3) AS total_s FROM segments
  WHERE audio_start_s IS NOT NULL AND align_score >= 0.2 AND word_count >= 4 AND duration_s BETWEEN 1.5 AND 15.0) WHERE total_s <= 400.0""",
    "zscore_profile": PRELUDE + """
, m AS (SELECT avg(duration_s) AS a1, stddev_pop(duration_s) AS s1, avg(align_score) AS a2, stddev_pop(align_score) AS s2, avg(word_count) AS a3, stddev_pop(word_count) AS s3 FROM segments WHERE audio_start_s IS NOT NULL)
SELECT book_id, book_seq, round(-((duration_s - a1) / s1 + (align_score - a2) / s2 + (word_count - a3) / s3) / 3, 3) AS subdued, round(((duration_s - a1) / s1 + (align_score - a2) / s2 + (word_count - a3) / s3) / 3, 3) AS intense
FROM segments, m WHERE audio_start_s IS NOT NULL""",
    "best_clip_per_emotion": PRELUDE + """
, e AS (SELECT *, CASE book_seq % 3 WHEN 0 THEN 'happy' WHEN 1 THEN 'sad' ELSE 'neutral' END AS emotion FROM segments WHERE audio_start_s IS NOT NULL),
t AS (SELECT *, count(*) OVER (PARTITION BY speaker, emotion) AS n, row_number() OVER (PARTITION BY speaker, emotion ORDER BY coalesce(align_score, 0) DESC, book_seq) AS k FROM e)
SELECT speaker, emotion, n, book_id, book_seq, align_score, duration_s FROM t WHERE n >= 3 AND k <= 8 QUALIFY row_number() OVER (PARTITION BY speaker, emotion ORDER BY coalesce(duration_s, 0) DESC, k) = 1""",
}
