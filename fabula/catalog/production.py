"""Queries of casting, rendering, quality, evaluation and page operators.

A job is a chapter of the corpus fixture (``corpora``); the ledger, verdicts and takes are computed from
lengths and ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.catalog import corpora as K
from fabula.functions.spoken import duration_text, number_words, with_spoken, word_key
from fabula.operators import evaluation as E
from fabula.operators import production as P
from fabula.sources.pages import page_text as pages_text

EMOTION = "case id % 3 when 0 then 'happy' when 1 then 'sad' else 'neutral' end"
GENDER = "case speaker when 'narrator' then 'neutral' when 'Clara' then 'female' when 'Clara Winslow' then 'female' when 'Winslow' then 'female' when 'unknown' then 'unknown' when 'Tobias' then 'unknown' else 'male' end"
STAGES = ("analysis", "synthesis", "assembly", "qa")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.segments(spark, sf_dir)
    rows = s.select(F.col("chapter_number").alias("job_id"), F.col("chapter_seq").cast("long").alias("id"), "speaker", F.regexp_replace("text", r"[\\\"\n\t\r]", " ").alias("text"), "duration_s", "align_score")
    return rows.withColumn("emotion", F.expr(EMOTION)).withColumn("intensity", F.expr("cast(id % 5 as double) / 4"))


PRELUDE = K.PRELUDE + f""", jobs AS (SELECT chapter_number AS job_id, chapter_seq AS id, speaker, regexp_replace(text, '[\\\\"\\n\\t\\r]', ' ', 'g') AS text, duration_s, align_score FROM segments),
j AS (SELECT *, {EMOTION} AS emotion, CAST(id % 5 AS DOUBLE) / 4 AS intensity FROM jobs),
printed AS (SELECT *, substr(sha256('{{"emotion": "' || emotion || '", "intensity": ' || CAST(intensity AS VARCHAR) || ', "speaker": "' || speaker || '", "text": "' || text || '"}}'), 1, 16) AS fingerprint FROM j),
events AS (SELECT job_id, id, 1 AS seq, CASE WHEN id % 4 = 0 THEN 'stale' ELSE fingerprint END AS fingerprint, 'c' || job_id || '_' || id AS clip FROM printed WHERE id % 5 <> 1
  UNION ALL SELECT job_id, id, 2, NULL, NULL FROM printed WHERE (job_id + id) % 7 = 0),
ledger AS (SELECT job_id, id, max_by(fingerprint, seq) AS fingerprint, CASE WHEN max(seq) = 1 THEN max(clip) END AS clip FROM events GROUP BY 1, 2 HAVING max(seq) = 1),
results AS (SELECT job_id, id, CASE WHEN id % 9 <> 8 THEN align_score END AS similarity, length(text) % 11 AS words, speaker FROM j)
"""


def _printed(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return j.withColumn("fingerprint", P.fingerprint(F.col("text"), speaker=F.col("speaker"), emotion=F.col("emotion"), intensity=F.col("intensity")))


def _ledger(spark, sf_dir):
    p = _printed(spark, sf_dir)
    first = p.filter("id % 5 <> 1").select("job_id", "id", F.lit(1).alias("seq"), F.when(F.col("id") % 4 == 0, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), F.concat_ws("_", F.concat(F.lit("c"), "job_id"), "id").alias("clip"))
    gone = p.filter("(job_id + id) % 7 = 0").select("job_id", "id", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("clip"))
    return P.ledger_state(first.unionByName(gone))


def fingerprint(spark, sf_dir):
    return _printed(spark, sf_dir).select("job_id", "id", "fingerprint")


def render_plan(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    return P.render_plan(_printed(spark, sf_dir), ledger, ledger.filter("(job_id * 3 + id) % 8 <> 0").select("clip"), jobs(spark, sf_dir).filter("job_id % 6 = 0 and id = 3"))


def redo_segments(spark, sf_dir):
    return P.redo(_ledger(spark, sf_dir), jobs(spark, sf_dir).filter("id % 2 = 0").select("job_id", "id"))


def autocast(spark, sf_dir):
    who = jobs(spark, sf_dir).select(F.expr("job_id % 10").alias("job_id"), "speaker", F.expr(GENDER).alias("gender")).distinct()
    return P.autocast(who.withColumn("voice", F.expr("if(speaker = 'Marlow' and job_id % 2 = 0, 'Dylan', null)")))


def hashed_cast(spark, sf_dir):
    bank = spark.createDataFrame([(v,) for v in ("Jason", "narrator", "Tobias", "Vera", "Otto", "Mina", "Karl")], "voice string")
    forced = spark.createDataFrame([("Marlow", "Mina"), ("Winslow", "Nobody")], "speaker string, voice string")
    return P.hashed_cast(jobs(spark, sf_dir).select(F.expr("job_id % 10").alias("job_id"), "speaker"), bank, forced)


def assembly_timeline(spark, sf_dir):
    clips = jobs(spark, sf_dir).select("job_id", "id", F.expr("case id % 3 when 0 then 300 when 1 then 0 else 500 end").alias("pause_before_ms"), F.expr("length(text) * 7 % 900").alias("duration_ms"))
    return P.timeline(clips)


def _results(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", "id", F.expr("if(id % 9 <> 8, align_score, null)").alias("similarity"), F.expr("length(text) % 11").alias("words"), "speaker")


def qa_report(spark, sf_dir):
    return P.quality_report(_results(spark, sf_dir), threshold=0.5)


def segment_view(spark, sf_dir):
    r = _results(spark, sf_dir).filter("similarity is not null")
    qa = r.select("job_id", "id", "similarity", F.expr("case when similarity >= 0.5 then 'passed' when words >= 4 then 'failed' else 'suspect' end").alias("status"))
    return P.segment_view(jobs(spark, sf_dir).select("job_id", "id", "speaker"), qa, _ledger(spark, sf_dir), failed=True)


def job_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.expr("user_id % 100").alias("job_id"), F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 4 + 1).cast("int")).alias("stage"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return P.job_summary(log.filter("stage <> 'qa' or job_id % 3 = 0"), _ledger(spark, sf_dir), STAGES)


def status_latest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), "value", "event_id")
    return P.latest_status(e, "job_id", "event_id", ["phase", "value"])


def best_take(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = e.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    takes = e.select(F.expr("l_orderkey % 50").alias("job_id"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("attempt"), F.expr("(l_partkey * 7 + l_linenumber) % 101 / cast(101 as double)").alias("score"))
    return P.best_take(takes)


def bench_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = e.select(F.col("o_orderpriority").alias("case"), F.expr("o_orderkey % 1000 / cast(8 as double)").alias("elapsed_s"), F.expr("o_custkey % 500 / cast(4 as double) + 1").alias("audio_s"))
    return P.bench_stats(runs)


def qa_similarity(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    heard = F.expr("case item_id % 4 when 0 then text when 1 then upper(text) when 2 then left(text, 150) else reverse(text) end")
    return E.similarity(b.select("item_id", F.col("text").alias("expected"), heard.alias("heard"))).select("item_id", F.round("similarity", 6).alias("similarity"))


def _quotes(spark, sf_dir):
    q = K.segments(spark, sf_dir).filter("kind = 'dialogue' and book_seq % 4 <> 0")
    label = F.expr("case book_seq % 5 when 0 then concat('[', speaker, ']') when 1 then split(speaker, ' ')[0] when 2 then 'Someone' when 3 then null else speaker end")
    return q.select(F.col("text").alias("quote"), label.alias("label"))


def _gold(spark, sf_dir):
    return E.gold_set(K.segments(spark, sf_dir).filter("kind = 'dialogue' and speaker <> 'unknown'").select("text", "speaker"))


def gold_set(spark, sf_dir):
    return _gold(spark, sf_dir)


def attribution_eval(spark, sf_dir):
    return E.accuracy(E.matched_quotes(_quotes(spark, sf_dir), _gold(spark, sf_dir)))


def confusion_topk(spark, sf_dir):
    return E.confusions(E.matched_quotes(_quotes(spark, sf_dir), _gold(spark, sf_dir)))


def cluster_labels(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    m = p.select(F.expr("p_size").alias("cluster"), F.col("p_partkey").alias("pos"), F.expr("case when p_size % 3 = 0 and p_partkey % 2 = 0 then 'PROP' when p_partkey % 5 = 0 then 'PRON' else 'NOM' end").alias("kind"), F.col("p_type").alias("text"))
    return E.cluster_labels(m)


def prefix_match(spark, sf_dir):
    s = K.segments(spark, sf_dir)
    q = s.filter("book_seq % 3 <> 0").select(F.col("book_seq").alias("pos"), "speaker", F.expr("case when book_seq % 2 = 0 then concat(text, ' and then some') else text end").alias("quote"))
    return E.speakers_by_quote(s.select(F.col("book_seq").alias("id"), "text"), q).select("id", "speaker", "match")


def page_text(spark, sf_dir):
    return pages_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), content=("article", ""))


def search_page(spark, sf_dir):
    """The second page of five segments whose text or speaker holds a word, whatever its case."""
    s = K.segments(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit("the")) | F.contains(F.lower("speaker"), F.lit("the")))
    return s.orderBy("book_id", "book_seq").offset(5).limit(5).select("book_id", "book_seq", "speaker")


STAT = "case doc_id % 6 when 0 then concat('Item: [', text, '] (rank ', n_chars % 100, '/', n_chars % 7, ', ???)') when 1 then concat('Effect: ??', chr(10), '***', chr(10), text) when 2 then concat(text, ' & co. ', n_chars % 1000, ' / ', doc_id % 1000) when 3 then concat('- - -', chr(10), 'Name: ( , ', text, ' )') else text end"

def _stat_blocks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(STAT).alias("t"))


def normalise_text(spark, sf_dir):
    return with_spoken(_stat_blocks(spark, sf_dir), F.col("t"), "spoken", {"The": "Thee", "The and": "Both"}).select("doc_id", "spoken")


def _scene_breaks(blocks):
    from fabula.functions.spoken import has_scene_break, scene_break_lines

    return blocks.select("doc_id", F.array_join(scene_break_lines(F.col("t")), "\n").alias("kept"), has_scene_break(F.col("t")).alias("had_break"))


def normalise_scene_breaks(spark, sf_dir):
    return _scene_breaks(_stat_blocks(spark, sf_dir))


def number_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", number_words(F.col("p_partkey") % 1000).alias("words"), duration_text(F.col("p_partkey") * 997).alias("duration"))


def word_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", word_key(F.col("text")).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        fingerprint, render_plan, redo_segments, autocast, hashed_cast, assembly_timeline, qa_report, segment_view, job_summary, status_latest, best_take, bench_stats,
        qa_similarity, gold_set, attribution_eval, confusion_topk, cluster_labels, prefix_match, page_text, search_page, normalise_text, normalise_scene_breaks, number_names, word_keys,
    )
}

KEY = "array_to_string(regexp_extract_all(lower({t}), '[a-z'']+'), ' ')"
GOLD = PRELUDE + f"""
, keyed AS (SELECT {KEY.format(t='text')} AS key, speaker FROM segments WHERE kind = 'dialogue' AND speaker <> 'unknown'),
gold AS (SELECT key, min(speaker) AS speaker FROM keyed WHERE len(string_split(key, ' ')) >= 4 GROUP BY 1 HAVING count(DISTINCT speaker) = 1),
quotes AS (SELECT {KEY.format(t='text')} AS key, CASE book_seq % 5 WHEN 0 THEN speaker WHEN 1 THEN split_part(speaker, ' ', 1) WHEN 2 THEN 'Someone' WHEN 3 THEN NULL ELSE speaker END AS got FROM segments WHERE kind = 'dialogue' AND book_seq % 4 <> 0),
matched AS (SELECT q.key, g.speaker AS want, q.got, CASE WHEN q.got IS NULL THEN 'unlabelled' WHEN contains(lower(q.got), lower(g.speaker)) OR contains(lower(g.speaker), lower(q.got)) THEN 'correct' ELSE 'wrong' END AS outcome FROM quotes q JOIN gold g USING (key))
"""

#: Spoken forms: lines, what is left of each, what of that is a ratio, and two terms (twice, as a match takes the signs beside it).
SPOKEN = r"""
WITH o AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS ones, string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS tens),
low AS (SELECT n, CASE WHEN n < 20 THEN ones[n + 1] ELSE tens[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || ones[n % 10 + 1] ELSE '' END END AS said FROM o, range(100) t(n)),
names AS (SELECT list(said ORDER BY n) AS names FROM (SELECT n, said FROM low UNION ALL SELECT h * 100 + n, ones[h + 1] || ' hundred' || CASE WHEN n > 0 THEN ' and ' || said ELSE '' END FROM low, o, range(1, 10) t(h))),
t AS (SELECT row_number() OVER () AS r, doc_id, BLOCKS AS t FROM documents),
cut AS (SELECT r, string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM t),
lines AS (SELECT r, unnest(CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END) AS line, unnest(range(len(CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END))) AS i FROM cut),
kept AS (SELECT r, i, line, regexp_extract(line, '^BLANK*([A-Z][A-Za-z ]{0,20}):', 1) AS label, regexp_replace(regexp_replace(line, '\[([^\]\n]{1,60})\]', '\1', 'g'), '\?{2,}', '', 'g') AS plain FROM lines
  WHERE regexp_matches(line, '[\p{L}\p{N}]') OR NOT regexp_matches(regexp_replace(line, '^BLANK+|BLANK+$', '', 'g'), '^(?:BLANK|[*\-—_#~=.]){3,}$')),
told AS (SELECT r, i, label, plain, regexp_replace(regexp_replace(regexp_replace(regexp_extract(plain, '^[^:]*:BLANK*(.*)$', 1), 'BLANK+$', ''), 'BLANK*\(([^)]*)\)', ', \1', 'g'), '^[ ,]+|[ ,]+$', '', 'g') AS value FROM kept),
said AS (SELECT r, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN label = '' THEN plain ELSE regexp_replace(regexp_replace(label || ': ' || value, '\[([^\]\n]{1,60})\]', '\1', 'g'), '\?{2,}', '', 'g') END,
    '\(BLANK*(?:,BLANK*){0,2}\)|(\()BLANK*,BLANK*|,BLANK*(\))', '\1\2', 'g'), 'BLANK+([.,;:!?])', '\1', 'g'), '^(?:BLANK|[.,;:])+', ''), 'BLANK+$', '') AS line FROM told WHERE label = '' OR value <> ''),
spoken AS (SELECT *, lead(i) OVER (PARTITION BY r ORDER BY i) IS NULL AS last FROM said WHERE regexp_matches(line, '[\p{L}\p{N}_]')),
j AS (SELECT r, string_agg(line || CASE WHEN last OR regexp_matches(line, '[.!?,;:—]$') THEN '' ELSE '.' END, ' ' ORDER BY i) AS t FROM spoken GROUP BY 1),
m AS (SELECT r, string_split_regex(t, '\b\d{1,3}BLANK*/BLANK*\d{1,3}\b') AS gaps, regexp_extract_all(t, '\b(\d{1,3})BLANK*/BLANK*(\d{1,3})\b', 1) AS a, regexp_extract_all(t, '\b(\d{1,3})BLANK*/BLANK*(\d{1,3})\b', 2) AS b FROM j),
n AS (SELECT r, array_to_string([gaps[k] || CASE WHEN k <= len(a) THEN names[CAST(a[k] AS INTEGER) + 1] || ' out of ' || names[CAST(b[k] AS INTEGER) + 1] ELSE '' END FOR k IN range(1, len(gaps) + 1)], '') AS t FROM m, names),
w AS (SELECT r, regexp_replace(t, 'BLANK*&BLANK*', ' and ', 'g') AS t FROM n),
x AS (SELECT r, list_reduce([t, 'The and', 'The and', 'The', 'The'], lambda s, term: regexp_replace(s, '(^|[^\p{L}\p{N}_])' || term || '($|[^\p{L}\p{N}_])', '\1' || CASE term WHEN 'The' THEN 'Thee' ELSE 'Both' END || '\2', 'g')) AS t FROM w)
SELECT doc_id, CASE WHEN t.t IS NOT NULL THEN coalesce(trim(regexp_replace(x.t, 'BLANK+', ' ', 'g')), '') END AS spoken FROM t LEFT JOIN x USING (r)"""

ORACLE_SQL = {
    "normalise_text": SPOKEN.replace("BLOCKS", STAT).replace("BLANK", r"[\s\p{Z}\x0b\x{85}\x1c-\x1f]"),
    "fingerprint": PRELUDE + "SELECT job_id, id, fingerprint FROM printed",
    "render_plan": PRELUDE + """
, d AS (SELECT p.job_id, p.id, p.fingerprint, l.clip, coalesce(l.fingerprint = p.fingerprint AND (p.job_id * 3 + p.id) % 8 <> 0 AND NOT (p.job_id % 6 = 0 AND p.id = 3), false) AS reuse FROM printed p LEFT JOIN ledger l USING (job_id, id))
SELECT job_id, id, fingerprint, CASE WHEN reuse THEN 'reuse' ELSE 'todo' END AS action, CASE WHEN reuse THEN clip END AS clip FROM d""",
    "redo_segments": PRELUDE + """
SELECT j.job_id, coalesce(string_agg(CAST(j.id AS VARCHAR), ',' ORDER BY j.id) FILTER (l.id IS NOT NULL), '') AS forgotten, coalesce(string_agg(CAST(j.id AS VARCHAR), ',' ORDER BY j.id) FILTER (l.id IS NULL), '') AS unknown
FROM j LEFT JOIN ledger l USING (job_id, id) WHERE j.id % 2 = 0 GROUP BY 1""",
    "autocast": PRELUDE.replace("WITH raw", "WITH RECURSIVE raw", 1) + f"""
, who AS (SELECT DISTINCT job_id % 10 AS job_id, speaker, {GENDER} AS gender, CASE WHEN speaker = 'Marlow' AND job_id % 2 = 0 THEN 'Dylan' END AS voice FROM jobs),
asked AS (SELECT job_id, speaker, gender, row_number() OVER (PARTITION BY job_id ORDER BY speaker) AS k FROM who WHERE voice IS NULL AND speaker <> 'narrator'),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS k, '' AS speaker, '' AS voice, CASE WHEN bool_or(voice IS NOT NULL) THEN ['Dylan', 'Ryan'] ELSE ['Ryan'] END AS used, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS f FROM who GROUP BY 1
  UNION ALL
  SELECT job_id, k, speaker, voice, list_append(used, voice), CASE WHEN gender = 'male' THEN m + passed ELSE m END, CASE WHEN gender = 'female' THEN f + passed ELSE f END FROM (
    SELECT *, coalesce(free[1], turn[1]) AS voice, coalesce(list_position(turn, free[1]), len(turn) + 1) AS passed FROM (
      SELECT *, [v FOR v IN turn IF NOT list_contains(used, v)] AS free FROM (
        SELECT a.*, p.used, p.m, p.f, CASE gender WHEN 'male' THEN [{list(P.MALE)}[(p.m + i) % {len(P.MALE)} + 1] FOR i IN range({len(P.MALE)})] WHEN 'female' THEN [{list(P.FEMALE)}[(p.f + i) % {len(P.FEMALE)} + 1] FOR i IN range({len(P.FEMALE)})]
          ELSE {[P.NEUTRAL, *P.MALE, *P.FEMALE]} END AS turn FROM fold p JOIN asked a ON a.job_id = p.job_id AND a.k = p.k + 1))))
SELECT job_id, speaker, voice FROM fold WHERE k > 0 UNION ALL SELECT job_id, speaker, coalesce(voice, 'Ryan') FROM who WHERE voice IS NOT NULL OR speaker = 'narrator'""",
    "hashed_cast": PRELUDE.replace("WITH raw", "WITH RECURSIVE raw", 1) + """
, who AS (SELECT DISTINCT job_id % 10 AS job_id, speaker FROM jobs WHERE speaker <> 'unknown'),
spares AS (SELECT job_id, CASE WHEN bool_or(speaker = 'Tobias') THEN ['Karl', 'Otto', 'Vera'] ELSE ['Karl', 'Otto', 'Tobias', 'Vera'] END AS spare FROM who GROUP BY 1),
hashed AS (SELECT job_id, speaker, spare, row_number() OVER (PARTITION BY job_id ORDER BY speaker) AS k, CAST(list_sum([(strpos('0123456789abcdef', substr(sha256(speaker), i, 1)) - 1) * 16 ** (8 - i) FOR i IN range(1, 9)]) AS BIGINT) % len(spare) AS first
  FROM who JOIN spares USING (job_id) WHERE speaker NOT IN ('narrator', 'Tobias', 'Marlow')),
asked AS (SELECT *, [spare[(first + i) % len(spare) + 1] FOR i IN range(len(spare))] AS turn FROM hashed),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS k, '' AS speaker, '' AS voice, ['Mina'] AS taken FROM spares
  UNION ALL
  SELECT job_id, k, speaker, voice, list_append(taken, voice) FROM (
    SELECT a.*, p.taken, coalesce([v FOR v IN turn IF NOT list_contains(p.taken, v)][1], turn[1]) AS voice FROM fold p JOIN asked a ON a.job_id = p.job_id AND a.k = p.k + 1))
SELECT job_id, speaker, voice FROM fold WHERE k > 0 UNION ALL SELECT job_id, speaker, CASE speaker WHEN 'Marlow' THEN 'Mina' ELSE speaker END FROM who WHERE speaker IN ('narrator', 'Tobias', 'Marlow')""",
    "assembly_timeline": PRELUDE.replace("WITH raw", "WITH RECURSIVE raw", 1) + """
, c AS (SELECT job_id, id, CASE id % 3 WHEN 0 THEN 300 WHEN 1 THEN 0 ELSE 500 END AS p, length(text) * 7 % 900 AS d FROM j),
f AS (SELECT job_id, id, CAST(p AS BIGINT) AS start, CAST(p + d AS BIGINT) AS stop FROM c WHERE id = 1
  UNION ALL SELECT c.job_id, c.id, CASE WHEN c.p > 0 THEN f.stop + c.p WHEN f.stop > 50 THEN f.stop - 50 ELSE f.stop END, CASE WHEN c.p > 0 THEN f.stop + c.p WHEN f.stop > 50 THEN f.stop - 50 ELSE f.stop END + c.d FROM f JOIN c ON c.job_id = f.job_id AND c.id = f.id + 1)
SELECT job_id, id, start AS start_ms, max_by(stop, id) OVER (PARTITION BY job_id) AS total_ms FROM f""",
    "qa_report": PRELUDE + """
SELECT job_id, count(similarity) AS checked, count(*) FILTER (similarity >= 0.5) AS passed, count(*) FILTER (similarity < 0.5 AND words >= 4) AS failed, count(*) FILTER (similarity < 0.5 AND words < 4) AS suspect,
  count(*) FILTER (similarity IS NULL) AS missing, round(coalesce(avg(round(similarity, 4)), 0.0), 4) AS mean_similarity FROM results GROUP BY 1""",
    "segment_view": PRELUDE + """
SELECT r.job_id, r.id, r.speaker, r.similarity, CASE WHEN words >= 4 THEN 'failed' ELSE 'suspect' END AS status, l.clip FROM results r LEFT JOIN ledger l USING (job_id, id) WHERE similarity < 0.5""",
    "job_summary": PRELUDE + """
, log AS (SELECT user_id % 100 AS job_id, CASE event_id % 4 WHEN 0 THEN 'analysis' WHEN 1 THEN 'synthesis' WHEN 2 THEN 'assembly' ELSE 'qa' END AS stage, event_type, event_id FROM main.events),
last AS (SELECT job_id, stage, max_by(event_type, event_id) AS status FROM log WHERE stage <> 'qa' OR job_id % 3 = 0 GROUP BY 1, 2),
n AS (SELECT job_id, count(*) AS clips FROM ledger GROUP BY 1)
SELECT l.job_id, coalesce(max(status) FILTER (stage = 'analysis'), 'not run') AS analysis, coalesce(max(status) FILTER (stage = 'synthesis'), 'not run') AS synthesis,
  coalesce(max(status) FILTER (stage = 'assembly'), 'not run') AS assembly, coalesce(max(status) FILTER (stage = 'qa'), 'not run') AS qa, coalesce(max(clips), 0) AS clips FROM last l LEFT JOIN n USING (job_id) GROUP BY 1""",
    "status_latest": "SELECT user_id AS job_id, count(*) AS events, max_by(event_type, event_id) AS phase, max_by(value, event_id) AS value FROM events GROUP BY 1",
    "best_take": """
WITH t AS (SELECT l_orderkey % 50 AS job_id, l_orderkey AS id, l_linenumber - 1 AS attempt, ((l_partkey * 7 + l_linenumber) % 101) / 101.0::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
b AS (SELECT *, max(score) OVER (PARTITION BY job_id, id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM t WHERE attempt <= 3),
k AS (SELECT * FROM b WHERE best IS NULL OR best < 0.95)
SELECT job_id, id, max(score) AS score, CAST(arg_max(attempt, {'s': score, 'a': -attempt}) AS INTEGER) AS attempt, min_by(score, attempt) AS before, count(*) AS tried, max(score) > min_by(score, attempt) AS improved FROM k GROUP BY 1, 2""",
    "bench_stats": """
SELECT o_orderpriority AS "case", count(*) AS segments, round(sum(e), 3) AS wall_s, round(sum(a), 3) AS audio_s, round(round(sum(e), 3) / round(sum(a), 3), 3) AS rtf, list_sort(list(e))[count(*) // 2 + 1] AS median_s, max(e) AS max_s
FROM (SELECT *, o_orderkey % 1000 / 8.0::DOUBLE AS e, o_custkey % 500 / 4.0::DOUBLE + 1 AS a FROM orders) GROUP BY 1""",
    "gold_set": GOLD + "SELECT key, speaker FROM gold",
    "attribution_eval": GOLD + """
SELECT count(*) AS matched, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'unlabelled') AS unlabelled, count(*) FILTER (outcome = 'wrong') AS wrong,
  round(100 * count(*) FILTER (outcome = 'correct') / greatest(count(*), 1), 1) AS percent FROM matched""",
    "confusion_topk": GOLD + "SELECT want, got, count(*) AS n FROM matched WHERE outcome = 'wrong' GROUP BY 1, 2 ORDER BY n DESC, want, got LIMIT 12",
    "cluster_labels": """
WITH m AS (SELECT p_size AS cluster, p_partkey AS pos, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'PROP' WHEN p_partkey % 5 = 0 THEN 'PRON' ELSE 'NOM' END AS kind, p_type AS text FROM part),
c AS (SELECT cluster, kind, text, count(*) AS n, min(pos) AS first FROM m WHERE kind <> 'PRON' GROUP BY 1, 2, 3)
SELECT cluster, CASE WHEN kind = 'PROP' THEN text ELSE '[' || text || ']' END AS label, n FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY kind = 'PROP' DESC, n DESC, first) = 1""",
    "prefix_match": PRELUDE + f"""
, s AS (SELECT *, {KEY.format(t='text')} AS key FROM segments),
q AS (SELECT book_seq AS pos, speaker, {KEY.format(t="CASE WHEN book_seq % 2 = 0 THEN text || ' and then some' ELSE text END")} AS key FROM segments WHERE book_seq % 3 <> 0),
e AS (SELECT key, max_by(speaker, pos) AS speaker, min(pos) AS pos FROM q WHERE key <> '' GROUP BY 1),
h AS (SELECT array_to_string(string_split(key, ' ')[1:6], ' ') AS head, min_by(speaker, pos) AS speaker FROM e WHERE len(string_split(key, ' ')) >= 6 GROUP BY 1)
SELECT s.book_seq AS id, coalesce(e.speaker, h.speaker) AS speaker, CASE WHEN e.speaker IS NOT NULL THEN 'exact' WHEN h.speaker IS NOT NULL THEN 'prefix' ELSE 'none' END AS match
FROM s LEFT JOIN e ON e.key = s.key LEFT JOIN h ON len(string_split(s.key, ' ')) >= 6 AND h.head = array_to_string(string_split(s.key, ' ')[1:6], ' ')""",
    # The test pages hold these references only.
    "page_text": r"""
WITH p AS (SELECT page_id, html, regexp_extract_all(regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1), '(?s)<p\b[^>]*>(.*?)</p>', 1) AS b FROM pages),
t AS (SELECT page_id, html, [regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '^\s+|\s+$', '', 'g'), '[ \t\x{a0}]+', ' ', 'g') FOR x IN b] AS l FROM p)
SELECT page_id, split_part(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]+)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), ' - ', 1) AS title, array_to_string([x FOR x IN l IF x <> ''], chr(10)) AS text,
  nullif(regexp_extract(html, '(?i)<a[^>]+href="([^"]+)"[^>]*>\s*Next\s*(?:Chapter)?\s*<', 1), '') AS next_href FROM t""",
    "search_page": PRELUDE + "SELECT book_id, book_seq, speaker FROM segments WHERE contains(lower(text), 'the') OR contains(lower(speaker), 'the') ORDER BY book_id, book_seq LIMIT 5 OFFSET 5",
    "normalise_scene_breaks": f"""
WITH t AS (SELECT doc_id, {STAT} AS t FROM documents),
r AS (SELECT doc_id, string_split_regex(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS r FROM t),
l AS (SELECT doc_id, [[x, regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')] FOR x IN CASE WHEN r[len(r)] = '' THEN r[:len(r) - 1] ELSE r END] AS l FROM r)
SELECT doc_id, array_to_string([x[1] FOR x IN l IF x[2] = '' OR NOT regexp_matches(x[2], '^[\\s*\\-—_#~=.]{{3,}}$')], chr(10)) AS kept,
  len([x FOR x IN l IF x[2] <> '' AND regexp_matches(x[2], '^[\\s*\\-—_#~=.]{{3,}}$')]) > 0 AS had_break FROM l""",
    "number_names": """
WITH w AS (SELECT 'zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen' AS o, 'twenty thirty forty fifty sixty seventy eighty ninety' AS t),
n AS (SELECT p_partkey, p_partkey % 1000 AS n, p_partkey * 997 AS ms, string_split(o, ' ') AS o, string_split(t, ' ') AS t FROM part, w),
b AS (SELECT *, n % 100 AS r, CASE WHEN n % 100 < 20 THEN o[n % 100 + 1] ELSE t[(n % 100) // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || o[n % 10 + 1] ELSE '' END END AS low FROM n)
SELECT p_partkey, CASE WHEN n < 100 THEN low WHEN r = 0 THEN o[n // 100 + 1] || ' hundred' ELSE o[n // 100 + 1] || ' hundred and ' || low END AS words,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ms // 1000 || 's' ELSE ms // 60000 || 'm ' || (ms // 1000) % 60 || 's' END AS duration FROM b""",
    "word_keys": f"SELECT item_id, {KEY.format(t='text')} AS key FROM benchmark",
}
