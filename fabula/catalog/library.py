"""Queries of pipelines, model seams, media columns, reports and streams.

Models are played by scripted clients: plain functions whose answers follow from ids and lengths, so that
the SQL beside them can tell what must come out, wrong answers and failures included."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.catalog import chapters as H
from fabula.catalog import corpora as K
from fabula.functions import media as M
from fabula.operators import corpus as C
from fabula.operators import reports as R
from fabula.operators import segments as S
from fabula.plans import models, stages
from fabula.sources import artifacts as A
from fabula.streaming import status as T

NAMES = ("Asher", "Ursula", "Marcus")
VOICES = ("Vera", "asher", "Otto", "Mina")


def naming_client(prompt: str) -> str:
    """Names a candidate for each line by its id; every fifth line gets someone who is not there."""
    request = json.loads(prompt)
    who = request["character_names"]
    pick = lambda i: "Nobody" if i % 5 == 0 or not who else f" {who[i % len(who)]} "
    return json.dumps({"attributions": [{"segment_id": q["segment_id"], "speaker": pick(q["segment_id"])} for q in request["queries"]]})


def feeling_client(prompt: str) -> str:
    """Emotions by id, some unknown and some too strong; fails where a batch starts with id 2."""
    items = json.loads(prompt)
    if items[0]["id"] == 2:
        raise TimeoutError("no answer")
    return json.dumps({"emotions": [{"id": x["id"], "emotion": (*models.EMOTIONS, "bored", "tired")[x["id"] % 11], "intensity": x["id"] / 4} for x in items]})


def judging_client(prompt: str) -> str:
    """Verdicts by the length of a name: a bare word, junk in every field, a failure, too much, and no JSON."""
    k = len(json.loads(prompt)["name"]) % 5
    if k == 2:
        raise ConnectionError("refused")
    return (
        '{"is_character": true, "canonical": "Edwin", "gender": male, "confidence": 0.9, "reason": "r"}',
        '{"is_character": "FALSE", "canonical": null, "gender": "other", "confidence": "high", "reason": null}',
        "",
        '{"is_character": "maybe", "canonical": "", "gender": "female", "confidence": 7, "reason": "' + "x" * 400 + '"}',
        "I think so",
    )[k]


def ai_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.attribute_explicit(S.split_segments(H.chapters(spark, sf_dir)))
    names = rows.select("chapter_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in NAMES])))
    return models.attribute_by_model(rows, names, naming_client).select(*H.WHO)


def emotion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.emotions_by_model(S.split_segments(H.chapters(spark, sf_dir)), feeling_client)
    return out.select("chapter_id", "id", "emotion", "intensity")


def registry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.verdicts(C.label_stats(K.segments(spark, sf_dir), 2), judging_client)


def registry_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded merges of every pair of labels are stored, turned to aliases beside the derived ones, and applied."""
    guarded = K.registry_guard(spark, sf_dir).filter("verdict = 'merge'").groupBy("book_id", "name").agg(F.min("canonical").alias("canonical"))
    new = guarded.select("book_id", "name", "canonical", ((F.length("name") % 10) / 10.0).alias("confidence"), F.lit("merge").alias("verdict"))
    stored = C.store_verdicts(new.limit(0), new)
    aliases = C.store_aliases(K.alias_derive(spark, sf_dir).drop("lines"), C.verdict_aliases(stored), evidence=False)
    out = C.apply_aliases(K.segments(spark, sf_dir), aliases)
    return out.groupBy("book_id", "speaker").agg(F.count(F.lit(1)).alias("lines"))


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.segmentation_summary(S.take_turns(S.attribute_explicit(S.split_segments(H.chapters(spark, sf_dir)))))


def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.Pipeline.from_names(stages.DEFAULT).run(H.chapters(spark, sf_dir))
    return S.output_projection(out).withColumn("text", F.length("text"))


PROBE = (
    "concat('{\"chapters\":[{\"start_time\":\"0\",\"end_time\":\"9.5\",\"tags\":{\"title\":\"Opening\"}},{\"start_time\":\"', n_nationkey, '.12345\",\"end_time\":\"', n_nationkey + 1, '\",\"tags\":{\"title\":\"', "
    "if(n_nationkey % 2 = 0, 'chapter ', 'Chapter  '), n_nationkey, if(n_nationkey % 3 = 0, ': ', ' '), n_name, ' \"}},{\"start_time\":\"1\",\"end_time\":\"2\"}]}')"
)


def audio_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", F.explode(A.markers(F.expr(PROBE))).alias("m")).select("n_nationkey", "m.*")


def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr("cast(c_custkey % 100 as double) * 7.5 + 1").alias("s"))
    return c.select("c_custkey", F.posexplode(M.encoder_windows(F.col("s"))).alias("k", "w")).select("c_custkey", "k", "w.*")


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.expr("element_at(array('wav', 'MP3', 'txt', ''), cast(p_partkey % 4 + 1 as int))")
    file = F.concat("p_name", F.lit("."), kind)
    speed = F.expr("cast(p_partkey % 9 as double) / 4")
    request = M.voice_request(F.expr("case p_partkey % 3 when 0 then '' when 1 then 'qwen3-tts' else 'xtts-v2' end"), F.expr("if(p_partkey % 2 = 0, p_brand, '')"))
    return p.select(
        "p_partkey", M.voice_file_name(F.col("p_name")).alias("voice_file"), M.media_type(file).alias("media_type"), M.output_name(file, "mp3").alias("output"), M.stage_folder(F.col("p_size"), F.col("p_brand")).alias("folder"),
        M.delivery(F.expr("if(p_partkey % 2 = 0, ' calm ', '')"), F.expr("if(p_partkey % 3 = 0, 'whispering', null)")).alias("delivery"),
        F.array_join(F.transform(M.tempo_steps(speed), lambda x: x.cast("string")), ",").alias("tempo"), M.gain_db(F.expr("-cast(p_partkey % 100 as double)")).alias("gain"),
        M.default_voice(F.expr("if(p_partkey % 5 = 0, 'Asher', 'Someone')"), F.col("p_partkey"), list(VOICES)).alias("voice"), request["engine"].alias("engine"), request["preset"].alias("preset"), request["reference"].alias("reference"),
        M.block_id(F.col("p_size"), F.col("p_partkey") % 7, 40_000, 1000).alias("block_id"), M.is_under(F.concat(F.lit("/out/"), "p_brand"), ["/out", "/tmp/x"]).alias("inside"),
    )


def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    header = F.expr("case p_partkey % 4 when 0 then 'bytes=5-' when 1 then concat('bytes=', p_partkey % 50, '-', p_partkey) when 2 then null else 'items=1-2' end")
    return p.select("p_partkey", M.byte_range(header, F.col("p_size").cast("long") * 20).alias("r")).select("p_partkey", "r.start", "r.end", "r.status")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return T.events_stream(spark, f"{path}*", spark.read.parquet(path).schema)  # a pattern, as a stream's path is else a folder


def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), "value", "event_id")
    return T.latest_status_stream(events, "job_id", "event_id", ["phase", "value"], T.work_dir(spark, "status")).drop("event_id")


def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _event_stream(spark, sf_dir).filter("event_id % 3 = 0").select(F.col("user_id").alias("job_id"))
    reused = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 10 = 1").groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n"))
    return T.progress_stream(done, reused, "job_id", T.work_dir(spark, "progress"))


def job_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    phase = F.element_at(F.array(*[F.lit(p) for p in (*T.PHASES, "error")]), (F.col("event_id") * 7 % 5 + 1).cast("int"))
    return T.phases(e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), phase.alias("phase")))


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip manifest of a book, written as lines of JSON and read again with its schema."""
    rows, path = K.clip_manifest(spark, sf_dir), T.work_dir(spark, "manifest")
    A.write_json_lines(rows, path)
    return A.json_lines(spark, path, rows.schema)


def produce_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    clips = o.select(F.expr("o_custkey % 40").alias("job_id"), F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey % 29 = 0, null, o_orderkey % 64 / cast(8 as double))").alias("audio_s"), F.expr("o_custkey % 32 / cast(16 as double)").alias("elapsed_s"))
    return R.production_report(clips)


def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extraction_totals(K.segments(spark, sf_dir))


def emotion_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        ai_attribution, emotion_labels, registry_verdicts, registry_apply, segment_summary, pipeline_run, audio_markers, audio_windows, media_names, byte_ranges,
        status_stream, progress_stream, job_phases, manifest_round_trip, produce_report, extraction_totals, emotion_frequencies,
    )
}

_GUARD = K.ORACLE_SQL["registry_guard"].removeprefix(K.PRELUDE + K.OWNERS).rsplit("\nSELECT", 1)[0]

ORACLE_SQL = {
    "ai_attribution": H.PRELUDE + f"""
, asked AS (SELECT chapter_id, id, (row_number() OVER (PARTITION BY chapter_id ORDER BY id) - 1) // 20 AS batch FROM explicit WHERE kind = 'dialogue' AND speaker = 'unknown'),
bounds AS (SELECT chapter_id, batch, min(id) - 12 AS lo, max(id) + 12 AS hi FROM asked GROUP BY 1, 2),
scene AS (SELECT b.chapter_id, b.batch, e.speaker, e.original_text FROM bounds b JOIN explicit e ON e.chapter_id = b.chapter_id AND e.id BETWEEN b.lo AND b.hi),
found AS (
  SELECT DISTINCT chapter_id, batch, speaker AS name FROM scene WHERE speaker NOT IN ('unknown', 'narrator')
  UNION SELECT DISTINCT chapter_id, batch, n FROM scene, (SELECT unnest({list(NAMES)}) AS n) WHERE regexp_matches(original_text, '\\b' || n || '\\b')),
cand AS (SELECT chapter_id, batch, list(name ORDER BY name) AS l FROM found GROUP BY 1, 2),
new AS (SELECT a.chapter_id, a.id, l[a.id % len(l) + 1] AS who FROM asked a JOIN cand c USING (chapter_id, batch) WHERE a.id % 5 <> 0)
SELECT e.chapter_id, e.id, e.kind, coalesce(n.who, e.speaker) AS speaker, CASE WHEN n.who IS NULL THEN e.attribution_source ELSE 'ai' END AS attribution_source FROM explicit e LEFT JOIN new n USING (chapter_id, id)""",
    "emotion_labels": H.PRELUDE + f"""
, b AS (SELECT *, (row_number() OVER (PARTITION BY chapter_id ORDER BY id) - 1) // 30 AS batch FROM merged WHERE kind = 'dialogue'),
f AS (SELECT chapter_id, id, min(id) OVER (PARTITION BY chapter_id, batch) <> 2 AND id % 11 < 9 AS ok FROM b)
SELECT m.chapter_id, m.id, CASE WHEN ok THEN {list(models.EMOTIONS)}[m.id % 11 + 1] ELSE 'neutral' END AS emotion, CASE WHEN ok THEN least(1.0::DOUBLE, m.id / 4.0::DOUBLE) ELSE 0.5::DOUBLE END AS intensity
FROM merged m LEFT JOIN f USING (chapter_id, id)""",
    "registry_verdicts": K.PRELUDE + """
, s AS (SELECT book_id, speaker AS name, count(*) AS lines, length(speaker) % 5 AS k FROM segments WHERE kind = 'dialogue' AND speaker NOT IN ('narrator', 'unknown') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT book_id, name, lines, CASE k WHEN 0 THEN true WHEN 1 THEN false END AS is_character, CASE k WHEN 0 THEN 'Edwin' END AS canonical, CASE k WHEN 0 THEN 'male' WHEN 3 THEN 'female' ELSE 'unknown' END AS gender,
  CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE k WHEN 0 THEN 'r' WHEN 2 THEN 'model call failed' WHEN 3 THEN repeat('x', 300) ELSE '' END AS reason FROM s""",
    "registry_apply": K.PRELUDE + K.DERIVED + _GUARD + """
, llm AS (SELECT book_id, name AS alias, min(canonical) AS canonical FROM k WHERE verdict = 'merge' AND length(name) % 10 >= 6 GROUP BY 1, 2),
al AS (SELECT coalesce(a.book_id, l.book_id) AS book_id, coalesce(a.alias, l.alias) AS alias, coalesce(l.canonical, a.canonical) AS canonical FROM aliases a FULL JOIN llm l ON l.book_id = a.book_id AND l.alias = a.alias)
SELECT s.book_id, coalesce(al.canonical, s.speaker) AS speaker, count(*) AS lines FROM segments s LEFT JOIN al ON al.book_id = s.book_id AND al.alias = s.speaker GROUP BY 1, 2""",
    "segment_summary": H.PRELUDE + """
SELECT chapter_id, count(*) AS segments, count(*) FILTER (kind = 'dialogue') AS dialogue, count(*) FILTER (kind = 'dialogue' AND speaker = 'unknown') AS unknown,
  count(DISTINCT speaker) FILTER (kind = 'dialogue' AND speaker <> 'unknown') AS characters, round(100 * count(*) FILTER (kind = 'dialogue' AND speaker = 'unknown') / count(*), 1) AS unattributed FROM final GROUP BY 1""",
    "pipeline_run": H.PRELUDE + """
SELECT chapter_id, id, CASE WHEN kind = 'dialogue' THEN speaker ELSE 'narrator' END AS speaker, CAST(length(spoken) AS INTEGER) AS text, pause_before_ms, 'neutral' AS emotion, 0.5::DOUBLE AS intensity
FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(original_text, '&', ' and '), '\\s+([.,;:!?])', '\\1', 'g'), '\\s+', ' ', 'g')) AS spoken FROM paused)""",
    "audio_markers": """
SELECT n_nationkey, CAST(n_nationkey AS INTEGER) AS number, n_name AS title, round(n_nationkey + 0.12345::DOUBLE, 3) AS audio_start_s, n_nationkey + 1.0::DOUBLE AS audio_end_s FROM nation""",
    "audio_windows": """
WITH c AS (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) * 7.5::DOUBLE + 1 AS s FROM customer),
n AS (SELECT *, CASE WHEN s <= 60 THEN 1 ELSE CAST(ceil((s - 60) / 54) AS INTEGER) + 1 END AS n FROM c),
w AS (SELECT c_custkey, s, n, unnest(range(0, n)) AS k FROM n)
SELECT c_custkey, CAST(k AS INTEGER) AS k, k * 54.0::DOUBLE AS start, least(k * 54.0::DOUBLE + 60, s) AS "end", CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE k * 54.0::DOUBLE + 3 END AS keep_from,
  CASE WHEN k = n - 1 THEN s ELSE least(k * 54.0::DOUBLE + 60, s) - 3 END AS keep_to FROM w""",
    "media_names": """
WITH p AS (SELECT *, p_name || '.' || ['wav', 'MP3', 'txt', ''][p_partkey % 4 + 1] AS file, CAST(p_partkey % 9 AS DOUBLE) / 4 AS speed FROM part)
SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS voice_file, ['audio/wav', 'audio/mpeg', 'application/octet-stream', 'application/octet-stream'][p_partkey % 4 + 1] AS media_type,
  CASE WHEN p_partkey % 4 = 1 THEN file ELSE p_name || '.mp3' END AS output, lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || p_brand AS folder,
  nullif(concat_ws(', ', CASE WHEN p_partkey % 2 = 0 THEN 'calm' END, CASE WHEN p_partkey % 3 = 0 THEN 'whispering' END), '') AS delivery,
  CASE WHEN speed = 1 OR speed < 0.25 OR speed > 4 THEN '' WHEN speed < 0.5 THEN '0.5,' || CAST(speed / 0.5 AS VARCHAR) ELSE CAST(speed AS VARCHAR) END AS tempo,
  CASE WHEN p_partkey % 100 < 80 THEN -20.0::DOUBLE + p_partkey % 100 ELSE 0.0::DOUBLE END AS gain, CASE WHEN p_partkey % 5 = 0 THEN 'asher' ELSE ['Vera', 'asher', 'Otto', 'Mina'][p_partkey % 4 + 1] END AS voice,
  CASE p_partkey % 3 WHEN 1 THEN 'qwen3-tts' ELSE 'xtts-v2' END AS engine, CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END END AS preset,
  CASE WHEN p_partkey % 3 <> 1 THEN '/voices/xtts/' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'generic_neutral.wav' END END AS reference,
  CAST(40000 + p_size * 1000 + p_partkey % 7 AS BIGINT) AS block_id, true AS inside FROM p""",
    "byte_ranges": """
WITH p AS (SELECT p_partkey, p_size * 20::BIGINT AS n FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN p_partkey % 50 ELSE 0 END AS start, CASE p_partkey % 4 WHEN 1 THEN least(p_partkey, n - 1) ELSE n - 1 END AS "end",
  CAST(CASE WHEN p_partkey % 4 < 2 THEN 206 ELSE 200 END AS INTEGER) AS status FROM p""",
    "status_stream": "SELECT user_id AS job_id, count(*) AS events, max_by(event_type, event_id) AS phase, max_by(value, event_id) AS value FROM events GROUP BY 1",
    "progress_stream": "SELECT user_id AS job_id, count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 10 = 1) AS completed FROM events WHERE event_id % 3 = 0 OR event_id % 10 = 1 GROUP BY 1",
    "job_phases": """
WITH e AS (SELECT user_id, event_id, event_id * 7 % 5 AS p FROM events)
SELECT user_id AS job_id, CASE WHEN max_by(p, event_id) = 4 THEN 'error' ELSE ['analyzing', 'synthesizing', 'verifying', 'done'][max(p) FILTER (p < 4) + 1] END AS phase FROM e GROUP BY 1""",
    "manifest_round_trip": K.ORACLE_SQL["clip_manifest"],
    "produce_report": """
WITH c AS (SELECT o_custkey % 40 AS job_id, o_orderkey AS id, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey % 64 / 8.0::DOUBLE END AS a, o_custkey % 32 / 16.0::DOUBLE AS e FROM orders)
SELECT job_id, count(a) AS synthesized, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (a IS NULL), '') AS failed, round(coalesce(sum(a), 0) / 60, 2) AS audio_minutes,
  round(CASE WHEN sum(a) > 0 THEN sum(e) / sum(a) END, 3) AS rtf FROM c GROUP BY 1""",
    "extraction_totals": K.PRELUDE + "SELECT book_id, count(DISTINCT chapter_number) AS chapters, CAST(sum(word_count) AS BIGINT) AS words, round(sum(coalesce(duration_s, 0.0::DOUBLE)), 3) AS seconds FROM segments GROUP BY 1",
    "emotion_frequencies": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
