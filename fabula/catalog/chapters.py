"""Queries of the chapter-text operators.

Chapters are made from ``conversations``: a chapter for each conv_id, a paragraph for each turn.  A
system turn is narration, an even turn is dialogue with a tag that names the speaker, an odd one is
dialogue without.  ``PRELUDE`` builds the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.functions import speech
from fabula.operators import segments as S

NAME = "case role when 'user' then case when conv_id % 4 = 3 then 'Marcus' else 'Ursula' end else 'Asher' end"
VERB = "case conv_id % 3 when 0 then 'said' when 1 then 'whispered' else 'asked' end"
TAIL = "case conv_id % 5 when 0 then ' and took her hat' when 1 then ' as he turned to him' else '' end"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, turn, p) of every chapter."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r'["“”«»\n\r]+', " "))
    name, verb, tail = F.expr(NAME), F.expr(VERB), F.expr(TAIL)
    tagged = F.when(F.col("conv_id") % 7 == 6, F.concat(F.lit(" "), F.expr("if(role = 'user', 'she', 'he')"), F.lit(" "), verb)).otherwise(F.concat(F.lit(" "), verb, F.lit(" "), name))
    p = F.when(F.col("role") == "system", clean).when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), clean, F.lit(',"'), tagged, tail, F.lit("."))).otherwise(F.concat(F.lit('"'), clean, F.lit('."')))
    return turns.select(F.col("conv_id").alias("chapter_id"), "turn", p.alias("p"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p"))).alias("t"))
    return rows.select("chapter_id", F.array_join(F.transform("t", lambda x: x["p"]), "\n").alias("text"))


PRELUDE = f"""
WITH RECURSIVE paras AS (
  SELECT conv_id AS chapter_id, turn,
    CASE WHEN role = 'system' THEN clean
         WHEN turn % 2 = 0 THEN '"' || clean || ',"' || (CASE WHEN conv_id % 7 = 6 THEN ' ' || (CASE WHEN role = 'user' THEN 'she' ELSE 'he' END) || ' ' || {VERB}
                                                              ELSE ' ' || {VERB} || ' ' || {NAME} END) || {TAIL} || '.'
         ELSE '"' || clean || '."' END AS p
  FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '["“”«»\\n\\r]+', ' ', 'g')) AS clean FROM conversations)),
lined AS (
  SELECT chapter_id, row_number() OVER w - 1 AS paragraph_index, p,
    coalesce(sum(length(p) + 1) OVER (PARTITION BY chapter_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM paras WINDOW w AS (PARTITION BY chapter_id ORDER BY turn)),
marked AS (
  SELECT chapter_id, paragraph_index, base,
    regexp_extract_all(replace(regexp_replace(p, '([A-Za-z0-9.,!?;…’''])"', '\\1' || chr(57345), 'g'), '"', chr(57344)),
      '[“«' || chr(57344) || '][^”»' || chr(57345) || ']*[”»' || chr(57345) || ']?|[^“«' || chr(57344) || ']+') AS spans
  FROM lined WHERE trim(p) <> ''),
cut AS (
  SELECT chapter_id, paragraph_index, base, i, spans[i] AS s, list_sum([length(x) FOR x IN spans[1:i-1]]) AS before FROM (SELECT *, unnest(range(1, len(spans) + 1)) AS i FROM marked)),
raw AS (
  SELECT chapter_id, paragraph_index, i, CASE WHEN substr(s, 1, 1) IN ('“', '«', chr(57344)) THEN 'dialogue' ELSE 'narration' END AS kind,
    replace(replace(trim(CASE WHEN substr(s, 1, 1) IN ('“', '«', chr(57344))
      THEN regexp_replace(substr(s, 2), '[”»' || chr(57345) || ']$', '') ELSE s END), chr(57344), '"'), chr(57345), '"') AS original_text,
    base + coalesce(before, 0) AS a, base + coalesce(before, 0) + length(s) AS b FROM cut),
segs AS (
  SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY paragraph_index, a) AS INTEGER) AS id, kind, original_text,
    CASE kind WHEN 'narration' THEN 'narrator' ELSE 'unknown' END AS speaker, CAST(paragraph_index AS INTEGER) AS paragraph_index,
    CAST(a AS INTEGER) AS char_offset_start, CAST(b AS INTEGER) AS char_offset_end
  FROM raw WHERE original_text <> ''),
runs AS (SELECT *, sum(CASE kind WHEN 'narration' THEN 0 ELSE 1 END) OVER (PARTITION BY chapter_id ORDER BY id) AS run FROM segs),
fold AS (
  SELECT chapter_id, id, kind, run, length(original_text) AS acc, id AS head FROM runs WHERE id = 1
  UNION ALL
  SELECT r.chapter_id, r.id, r.kind, r.run,
    CASE WHEN f.kind = 'narration' AND r.kind = 'narration' AND f.acc + length(r.original_text) + 1 <= 800 THEN f.acc + length(r.original_text) + 1 ELSE length(r.original_text) END,
    CASE WHEN f.kind = 'narration' AND r.kind = 'narration' AND f.acc + length(r.original_text) + 1 <= 800 THEN f.head ELSE r.id END
  FROM fold f JOIN runs r ON r.chapter_id = f.chapter_id AND r.id = f.id + 1),
merged AS (
  SELECT s.chapter_id, CAST(row_number() OVER (PARTITION BY s.chapter_id ORDER BY f.head) AS INTEGER) AS id, min(s.kind) AS kind,
    string_agg(s.original_text, chr(10) ORDER BY s.id) AS original_text, min(s.speaker) AS speaker, min_by(s.paragraph_index, s.id) AS paragraph_index,
    min(s.char_offset_start) AS char_offset_start, max_by(s.char_offset_end, s.id) AS char_offset_end
  FROM segs s JOIN fold f USING (chapter_id, id) GROUP BY s.chapter_id, f.head),
beside AS (
  SELECT *, CASE WHEN lag(kind) OVER c = 'narration' THEN lag(original_text) OVER c END AS prev_text,
    CASE WHEN lead(kind) OVER c = 'narration' THEN lead(original_text) OVER c END AS next_text, lag(kind) OVER c AS prev_kind,
    paragraph_index - lag(paragraph_index) OVER c AS gap
  FROM merged WINDOW c AS (PARTITION BY chapter_id ORDER BY id)),
ctx AS (SELECT *, CASE WHEN kind = 'dialogue' THEN nullif(concat_ws(' ', prev_text, next_text), '') END AS context FROM beside),
tagged AS (
  SELECT *, (SELECT x FROM (SELECT unnest(names) AS x, generate_subscripts(names, 1) AS k) WHERE length(x) >= 2 AND NOT list_has_any(string_split_regex(lower(x), '\\s+'), {list(speech.NON_NAMES)}) ORDER BY k LIMIT 1) AS name FROM (
    SELECT *, [trim(regexp_replace(n, '^(?i:the)\\s+', '')) FOR n IN list_concat(
      regexp_extract_all(coalesce(context, ''), '{speech.VERB_NAME}', 1), regexp_extract_all(coalesce(context, ''), '{speech.NAME_VERB}', 1))] AS names FROM ctx)),
explicit AS (
  SELECT * EXCLUDE (speaker, names, name), coalesce(name, speaker) AS speaker,
    CASE WHEN name IS NOT NULL THEN 'explicit' WHEN pron = 'he' THEN 'pronoun_male' WHEN pron = 'she' THEN 'pronoun_female' ELSE 'none' END AS attribution_source
  FROM (SELECT *, coalesce(nullif(lower(regexp_extract(context, '{speech.PRONOUN_VERB}', 1)), ''), nullif(lower(regexp_extract(context, '{speech.VERB_PRONOUN}', 1)), '')) AS pron FROM tagged)),
hints AS (
  SELECT chapter_id, speaker, id, side, CASE WHEN regexp_matches(t, ' (he|his|him) ') THEN 'male' WHEN regexp_matches(t, ' (she|her|hers) ') THEN 'female' END AS gender
  FROM (SELECT chapter_id, speaker, id, 0 AS side, lower(prev_text) AS t FROM explicit WHERE attribution_source = 'explicit'
        UNION ALL SELECT chapter_id, speaker, id, 1, lower(next_text) FROM explicit WHERE attribution_source = 'explicit')),
genders AS (SELECT chapter_id, speaker, max_by(gender, id * 2 + side) AS gender FROM hints WHERE gender IS NOT NULL GROUP BY ALL),
only_one AS (SELECT chapter_id, 'pronoun_' || gender AS attribution_source, min(speaker) AS one FROM genders GROUP BY ALL HAVING count(*) = 1),
pronouns AS (
  SELECT e.* EXCLUDE (speaker, attribution_source), coalesce(o.one, e.speaker) AS speaker, CASE WHEN o.one IS NULL THEN e.attribution_source ELSE 'turn_taking' END AS attribution_source
  FROM explicit e LEFT JOIN only_one o USING (chapter_id, attribution_source)),
turns AS (
  SELECT chapter_id, 0 AS id, CAST(NULL AS VARCHAR) AS p2, CAST(NULL AS VARCHAR) AS p1, 0 AS streak, CAST(NULL AS VARCHAR) AS given FROM (SELECT DISTINCT chapter_id FROM pronouns)
  UNION ALL
  SELECT t.chapter_id, s.id,
    CASE WHEN s.kind = 'narration' THEN CASE WHEN t.streak >= 1 THEN NULL ELSE t.p2 END
         WHEN s.speaker <> 'unknown' AND s.attribution_source <> 'none' THEN CASE WHEN t.p1 IS NULL OR t.p1 <> s.speaker THEN t.p1 ELSE t.p2 END
         WHEN t.p2 IS NOT NULL THEN t.p1 ELSE t.p2 END,
    CASE WHEN s.kind = 'narration' THEN CASE WHEN t.streak >= 1 THEN NULL ELSE t.p1 END
         WHEN s.speaker <> 'unknown' AND s.attribution_source <> 'none' THEN s.speaker
         WHEN t.p2 IS NOT NULL THEN t.p2 ELSE t.p1 END,
    CASE WHEN s.kind = 'narration' THEN t.streak + 1 ELSE 0 END,
    CASE WHEN s.kind = 'narration' OR (s.speaker <> 'unknown' AND s.attribution_source <> 'none') THEN NULL ELSE coalesce(t.p2, t.p1) END
  FROM turns t JOIN pronouns s ON s.chapter_id = t.chapter_id AND s.id = t.id + 1),
alternated AS (
  SELECT p.* EXCLUDE (speaker, attribution_source), coalesce(t.given, p.speaker) AS speaker, CASE WHEN t.given IS NULL THEN p.attribution_source ELSE 'turn_taking' END AS attribution_source
  FROM pronouns p JOIN turns t USING (chapter_id, id)),
named AS (SELECT chapter_id, min(speaker) AS one FROM alternated WHERE kind = 'dialogue' AND speaker NOT IN ('unknown', 'narrator') GROUP BY 1 HAVING count(DISTINCT speaker) = 1),
final AS (
  SELECT a.* EXCLUDE (speaker, attribution_source), CASE WHEN a.kind = 'dialogue' AND a.speaker = 'unknown' THEN coalesce(n.one, a.speaker) ELSE a.speaker END AS speaker,
    CASE WHEN a.kind = 'dialogue' AND a.speaker = 'unknown' AND n.one IS NOT NULL THEN 'sole_character' ELSE a.attribution_source END AS attribution_source
  FROM alternated a LEFT JOIN named n USING (chapter_id)),
paused AS (
  SELECT *, CASE WHEN prev_kind IS NULL THEN 0 WHEN gap > 1 AND NOT (prev_kind = 'narration' AND kind = 'narration') THEN 1000 WHEN gap >= 1 THEN 500
    WHEN prev_kind = 'narration' AND kind = 'dialogue' THEN 350 WHEN prev_kind = 'dialogue' AND kind = 'narration' THEN 300
    WHEN prev_kind = 'dialogue' AND kind = 'dialogue' THEN 250 ELSE 500 END AS pause_before_ms FROM final)
"""


def _quoted(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    return S.paragraph_segments(rows.select("chapter_id", (F.row_number().over(S.per_chapter("turn")) - 1).alias("paragraph_index"), "p"))


def _split(spark, sf_dir):
    return S.merge_narration(_quoted(spark, sf_dir))


def _explicit(spark, sf_dir):
    return S.attribute_explicit(_split(spark, sf_dir))


def _final(spark, sf_dir):
    return S.take_turns(_explicit(spark, sf_dir))


WHO = ["chapter_id", "id", "kind", "speaker", "attribution_source"]


def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir).drop("attribution_source")


def narration_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is narration."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chapter_id"), F.translate(F.regexp_replace("text", '["“”«»]', ""), "\t\r", "  ").alias("text"))
    out = S.split_segments(docs)
    return out.select("chapter_id", "id", "paragraph_index", F.length("original_text").alias("chars"))


def explicit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explicit(spark, sf_dir).select(*WHO)


def pronoun_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_pronouns(_explicit(spark, sf_dir)).select(*WHO)


def turn_taking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alternate_speakers(S.resolve_pronouns(_explicit(spark, sf_dir))).select(*WHO)


def sole_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select(*WHO)


def character_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.character_registry(_final(spark, sf_dir))


def pause_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_pauses(_split(spark, sf_dir)).select("chapter_id", "id", "pause_before_ms")


def cast_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and speaker: lines, characters and silence before them."""
    rows = S.assign_pauses(_final(spark, sf_dir))
    return rows.groupBy("kind", "speaker").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("original_text")).alias("chars"), F.sum("pause_before_ms").alias("pause_ms")
    )


def validate_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line of a chapter is lost on purpose."""
    return S.validate_completeness(chapters(spark, sf_dir), _split(spark, sf_dir).filter("id % 7 <> 0"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.context_windows(_explicit(spark, sf_dir))
    said = F.array_join(F.transform("context", lambda x: F.concat_ws("|", x["id"].cast("string"), x["kind"], x["speaker"], F.length(x["text"]).cast("string"))), ";")
    return out.select("chapter_id", "id", said.alias("context"))


def llm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.llm_batches(_explicit(spark, sf_dir), size=2)
    return out.select("chapter_id", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def scene_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _explicit(spark, sf_dir)
    names = rows.select("chapter_id").distinct().withColumn("name", F.explode(F.array(F.lit("Asher"), F.lit("Ursula"), F.lit("Marcus"))))
    out = S.scene_candidates(rows, names, around=2, size=2)
    return out.select("chapter_id", "batch", F.array_join("candidates", ",").alias("candidates"))


def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("chapter_id"), F.lit(1).alias("id"), F.lit("narration").alias("kind"), F.regexp_replace("text", "[.,] ", " ").alias("original_text"))
    return S.candidate_names(rows)


def output_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.normalise_segments(S.assign_pauses(_final(spark, sf_dir)))
    rows = rows.withColumn("emotion", F.when(F.col("id") % 3 == 0, "happy").otherwise("neutral")).withColumn("intensity", (F.col("id") % 10).cast("double") / 10)
    return S.output_projection(rows).withColumn("text", F.length("text"))


CAST = "SELECT chapter_id, id, kind, speaker, attribution_source FROM"

QUERIES = {
    f.__name__: f
    for f in (
        cast_sheet, segment_split, narration_merge, explicit_attribution, pronoun_resolution, turn_taking, sole_character, character_registry, pause_timing,
        validate_completeness, context_windows, llm_batches, scene_candidates, candidate_names, output_projection,
    )
}

ORACLE_SQL = {
    "cast_sheet": PRELUDE + "SELECT kind, speaker, count(*) AS lines, CAST(sum(length(original_text)) AS BIGINT) AS chars, CAST(sum(pause_before_ms) AS BIGINT) AS pause_ms FROM paused GROUP BY ALL",
    "segment_split": PRELUDE + "SELECT * FROM segs",
    "narration_merge": """
WITH RECURSIVE lines AS (
  SELECT doc_id, p, len, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS id FROM (
    SELECT doc_id, unnest(range(0, len(l))) AS p, unnest([length(trim(x)) FOR x IN l]) AS len
    FROM (SELECT doc_id, string_split(translate(regexp_replace(text, '["“”«»]', '', 'g'), chr(9) || chr(13), '  '), chr(10)) AS l FROM documents)) WHERE len > 0),
fold AS (
  SELECT doc_id, id, len AS acc, id AS head FROM lines WHERE id = 1
  UNION ALL
  SELECT l.doc_id, l.id, CASE WHEN f.acc + l.len + 1 <= 800 THEN f.acc + l.len + 1 ELSE l.len END, CASE WHEN f.acc + l.len + 1 <= 800 THEN f.head ELSE l.id END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.id = f.id + 1)
SELECT f.doc_id AS chapter_id, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY f.head) AS INTEGER) AS id,
  CAST(min(l.p) AS INTEGER) AS paragraph_index, CAST(max(f.acc) AS INTEGER) AS chars
FROM fold f JOIN lines l USING (doc_id, id) GROUP BY f.doc_id, f.head""",
    "explicit_attribution": PRELUDE + f"{CAST} explicit",
    "pronoun_resolution": PRELUDE + f"{CAST} pronouns",
    "turn_taking": PRELUDE + f"{CAST} alternated",
    "sole_character": PRELUDE + f"{CAST} final",
    "character_registry": PRELUDE + r"""
, votes AS (
  SELECT chapter_id, id, kind, speaker,
    CAST(coalesce(regexp_matches(prev_text, '(?i)\b(he|him|his)\b'), false) AS INT) + CAST(coalesce(regexp_matches(next_text, '(?i)\b(he|him|his)\b'), false) AS INT) AS m,
    CAST(coalesce(regexp_matches(prev_text, '(?i)\b(she|her|hers)\b'), false) AS INT) + CAST(coalesce(regexp_matches(next_text, '(?i)\b(she|her|hers)\b'), false) AS INT) AS f FROM final),
roles AS (
  SELECT chapter_id, speaker AS name, count(*) AS segments, CAST(sum(m) AS BIGINT) AS male_votes, CAST(sum(f) AS BIGINT) AS female_votes, min(id) AS seen,
    CASE WHEN sum(m) > sum(f) THEN 'male' WHEN sum(f) > sum(m) THEN 'female' ELSE 'unknown' END AS gender
  FROM votes WHERE kind = 'dialogue' AND speaker NOT IN ('unknown', 'narrator') GROUP BY 1, 2
  UNION ALL SELECT chapter_id, 'narrator', count(*) FILTER (speaker = 'narrator'), 0, 0, 0, 'neutral' FROM votes GROUP BY 1)
SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY seen) - 1 AS INTEGER) AS position, name, gender, segments, male_votes, female_votes FROM roles""",
    "pause_timing": PRELUDE + "SELECT chapter_id, id, pause_before_ms FROM paused",
    "validate_completeness": PRELUDE + r"""
, a AS (SELECT chapter_id, trim(regexp_replace(regexp_replace(string_agg(p, chr(10) ORDER BY paragraph_index), '[“”"]', '', 'g'), '\s+', ' ', 'g')) AS a FROM lined GROUP BY 1),
b AS (SELECT chapter_id, trim(regexp_replace(regexp_replace(string_agg(original_text, ' ' ORDER BY id), '[“”"]', '', 'g'), '\s+', ' ', 'g')) AS b FROM merged WHERE id % 7 <> 0 GROUP BY 1),
w AS (SELECT chapter_id, a, b, [x FOR x IN string_split(a, ' ') IF x <> ''] AS x, [y FOR y IN string_split(coalesce(b, ''), ' ') IF y <> ''] AS y FROM a LEFT JOIN b USING (chapter_id)),
d AS (SELECT *, list_position([x[k] <> y[k] FOR k IN range(1, least(len(x), len(y)) + 1)], true) - 1 AS first FROM w)
SELECT chapter_id, coalesce(a = b, false) AS passed, CAST(len([v FOR v IN list_distinct(x) IF NOT list_contains(y, v)]) AS INTEGER) AS n_missing,
  CAST(len([v FOR v IN list_distinct(y) IF NOT list_contains(x, v)]) AS INTEGER) AS n_extra, CASE WHEN first >= 0 THEN CAST(first AS BIGINT) END AS first_mismatch,
  CAST(len(x) AS INTEGER) AS n_original, CAST(len(y) AS INTEGER) AS n_segments FROM d""",
    "context_windows": PRELUDE + """
SELECT e.chapter_id, e.id, string_agg(concat_ws('|', n.id, n.kind, n.speaker, least(length(n.original_text), 200)), ';' ORDER BY n.id) AS context
FROM explicit e JOIN explicit n ON n.chapter_id = e.chapter_id AND n.id BETWEEN e.id - 6 AND e.id + 6
WHERE e.kind = 'dialogue' AND e.speaker = 'unknown' GROUP BY 1, 2""",
    "llm_batches": PRELUDE + """
SELECT chapter_id, batch, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (
  SELECT chapter_id, id, CAST((row_number() OVER (PARTITION BY chapter_id ORDER BY id) - 1) // 2 AS INTEGER) AS batch FROM explicit WHERE kind = 'dialogue' AND speaker = 'unknown')
GROUP BY 1, 2""",
    "scene_candidates": PRELUDE + """
, asked AS (SELECT chapter_id, id, CAST((row_number() OVER (PARTITION BY chapter_id ORDER BY id) - 1) // 2 AS INTEGER) AS batch FROM explicit WHERE kind = 'dialogue' AND speaker = 'unknown'),
bounds AS (SELECT chapter_id, batch, min(id) - 2 AS lo, max(id) + 2 AS hi FROM asked GROUP BY 1, 2),
scene AS (SELECT b.chapter_id, b.batch, e.speaker, e.original_text FROM bounds b JOIN explicit e ON e.chapter_id = b.chapter_id AND e.id BETWEEN b.lo AND b.hi),
found AS (
  SELECT DISTINCT chapter_id, batch, speaker AS name FROM scene WHERE speaker NOT IN ('unknown', 'narrator')
  UNION SELECT DISTINCT chapter_id, batch, n FROM scene, (SELECT unnest(['Asher', 'Ursula', 'Marcus']) AS n) WHERE regexp_matches(original_text, '\\b' || n || '\\b'))
SELECT b.chapter_id, b.batch, coalesce(string_agg(f.name, ',' ORDER BY f.name), '') AS candidates FROM bounds b LEFT JOIN found f USING (chapter_id, batch) GROUP BY 1, 2""",
    "candidate_names": f"""
WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(text, '[.,] ', ' ', 'g'), '\\s') AS l FROM documents),
words AS (
  SELECT doc_id, k AS pos, regexp_extract(l[k], '^[A-Z][a-z]{{2,}}') AS name FROM (SELECT doc_id, l, unnest(range(2, len(l) + 1)) AS k FROM t)
  WHERE regexp_matches(l[k], '^[A-Z][a-z]{{2,}}') AND regexp_matches(l[k - 1], '[a-z.,;!?’]$')),
n AS (SELECT doc_id, name, count(*) AS mentions, min(pos) AS first FROM words WHERE NOT list_contains({list(speech.COMMON_CAPITALS)}, name) GROUP BY 1, 2)
SELECT doc_id AS chapter_id, CAST(rank AS INTEGER) AS rank, name, mentions FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, first) AS rank FROM n)
WHERE rank <= 10 AND mentions >= 2""",
    "output_projection": PRELUDE + """
SELECT chapter_id, id, CASE WHEN kind = 'dialogue' THEN speaker ELSE 'narrator' END AS speaker, CAST(length(spoken) AS INTEGER) AS text, pause_before_ms,
  CASE WHEN kind = 'dialogue' AND id % 3 = 0 THEN 'happy' ELSE 'neutral' END AS emotion, CASE WHEN kind = 'dialogue' THEN (id % 10) / 10.0::DOUBLE ELSE 0.5::DOUBLE END AS intensity
FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(original_text, '&', ' and '), '\\s+([.,;:!?])', '\\1', 'g'), '\\s+', ' ', 'g')) AS spoken FROM paused)""",
}
