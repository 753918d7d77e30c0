"""Queries of casting, manifests, lost files, headings, alignment blocks and worst-first lists.

Casts and manifests are written as YAML and JSON from rows of the tables and read again by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.catalog import chapters as H
from fabula.catalog import corpora as K
from fabula.catalog import production as J
from fabula.operators import casting as V
from fabula.operators import segments as S
from fabula.operators import selection as L
from fabula.plans import alignment as W
from fabula.sources import artifacts as A

PROFILES = (("default", "Ryan"), ("Clara", "Vera"), ("Edwin", None), ("Marlow", "Otto"))
ASSIGNED = "case speaker when 'Edwin' then 'Tobias' when 'unknown' then 'Nobody' else speaker end"
ENGINE = "case p_partkey % 4 when 0 then 'xtts-v2' when 1 then 'qwen3-tts' when 2 then 'other' else '' end"
BACKENDS = '{"xtts-v2": "http://a:1", "qwen3-tts": ["http://b:1", "http://b:2"]}'
WORDS = "cast(p_partkey * 37 % 5000 as int)"


def _nations(spark: SparkSession, sf_dir: str, row) -> DataFrame:
    """(n_regionkey, rows): the region's nations in order of key, each as ``row``."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", F.struct("n_nationkey", row.alias("row")).alias("r"))
    return n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]).alias("rows"))


def voice_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.format_string('  %s:\n    tts_service: xtts-v2  # engine\n    speed: 1.%d\n    style_notes: "calm: %d"\n', "n_name", F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long"))
    text = F.concat(F.lit("# cast\nvoices:\n"), F.array_join("rows", "\n"), F.lit("engines:\n  none:\n    tts_service: x\n"))
    return A.voice_profiles(_nations(spark, sf_dir, profile).select(F.col("n_regionkey").alias("cast"), text.alias("text")))


def profile_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = K.segments(spark, sf_dir).select("book_id", "book_seq", "speaker")
    return V.with_profiles(lines, spark.createDataFrame(PROFILES, "speaker string, voice string"), "Eric")


def engine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(ENGINE).alias("engine"))
    config = A.backends(spark.createDataFrame([(BACKENDS,)], "text string"))
    return V.routed(requests, config, "xtts-v2").withColumn("urls", F.array_join("urls", ","))


def _cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.segments(spark, sf_dir)
    asked = s.select(F.expr("chapter_number % 10").alias("job_id"), "speaker").distinct().withColumn("voice", F.expr(ASSIGNED))
    bank = s.filter("audio_start_s is not null").select(F.col("speaker").alias("voice"), F.col("book_seq").alias("place"), F.format_string("b%d.wav", F.col("book_seq").cast("long")).alias("file"), F.col("kind").alias("text"), "align_score", "duration_s")
    pins = spark.createDataFrame(
        [("Clara", V.PRESET_ENGINE, "Vivian", None, None, None, None), ("Clara Winslow", None, None, "pin.wav", "Hello", 0.5, 3.0)],
        "speaker string, engine string, qwen_speaker string, file string, text string, align_score double, duration_s double",
    )
    return V.assembled_cast(asked, bank, pins)


def cast_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cast(spark, sf_dir)


def cast_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.cast_manifests(_cast(spark, sf_dir))
    return out.select("job_id", "manifest", "speaker", F.get_json_object("entry", "$.file").alias("file"), F.get_json_object("entry", "$.qwen_speaker").alias("preset"))


def bank_by_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank's manifest for each region, read again; each nation asks for a happy, a sad and a calm clip."""
    clip = lambda k, emotion, score: F.struct(
        F.format_string("%d_%d.wav", F.col("n_nationkey").cast("long"), F.lit(k)).alias("file"), F.col("n_name").alias("text"), F.expr(f"cast({score} as double)").alias("align_score"), F.lit(2.5).alias("duration_s"), F.expr(emotion).alias("emotion")
    )
    clips = F.array(clip(0, "'Happy'", "n_nationkey % 10 / 10"), clip(1, "if(n_nationkey % 2 = 0, null, 'sad')", "null"), clip(2, "'happy'", "n_nationkey * 3 % 10 / 10"))
    text = F.to_json(F.struct(F.map_from_entries("rows").alias("voices")))
    bank = A.bank_entries(_nations(spark, sf_dir, F.struct(F.col("n_name").alias("key"), clips.alias("value"))).select(F.col("n_regionkey").alias("source"), text.alias("text")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("speaker"), F.explode(F.array(F.lit("happy"), F.lit("sad"), F.lit("calm"))).alias("emotion"))
    return V.clip_for_line(n, bank)


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.concat("n_name", F.lit(".wav")).alias("key"), F.struct(F.concat("n_name", F.lit(' "x"')).alias("text"), F.col("n_nationkey").cast("double").alias("duration_s")).alias("value"))
    return A.manifest_entries(_nations(spark, sf_dir, entry).select(F.col("n_regionkey").alias("source"), F.to_json(F.map_from_entries("rows")).alias("text")), "text string, duration_s double")


def latest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = J.jobs(spark, sf_dir).select("job_id", "id", F.format_string("/w/%d/seg%04d", F.col("job_id").cast("long"), "id").alias("stem"))
    there = jobs.filter("id % 3 = 0").select(F.concat("stem", F.lit(".wav")).alias("path"), F.lit(1).alias("modified"))
    takes = jobs.filter("id % 3 < 2").select(F.explode(F.array(*[F.struct(F.concat("stem", F.lit(f"_{k}.wav")).alias("path"), F.expr(f"cast(id * {m} % 5 as int)").alias("modified")) for k, m in (("a", 2), ("b", 3))])).alias("f")).select("f.*")
    return V.resolved_clips(jobs.select("job_id", "id", F.concat("stem", F.lit(".wav")).alias("path")), there.unionByName(takes))


def quote_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    mentions = p.select(F.col("p_size").cast("long").alias("character"), F.col("p_partkey").alias("place"), F.expr("if(p_partkey % 4 = 0, 'LOC', 'PER')").alias("cat"), F.expr("if(p_size % 3 = 0, 'NOM', 'PROP')").alias("prop"), F.col("p_type").alias("text"))
    quotes = o.select(F.col("o_orderkey").alias("quote_start"), (F.col("o_orderkey") + 10).alias("quote_end"), F.expr("cast(o_custkey % 60 as bigint)").alias("character"), F.expr("if(o_orderkey % 2 = 0, 'they', null)").alias("mention"), F.expr("repeat(o_orderpriority, 40)").alias("quote"))
    return V.speakers_of_quotes(quotes, mentions)


def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = J.jobs(spark, sf_dir).select("job_id", "id", F.col("align_score").alias("similarity"), F.expr("length(text) % 11").alias("words"))
    return V.worst_first(results, threshold=0.5)


def passage_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.segments(spark, sf_dir).select(F.col("chapter_number").alias("chapter_id"), F.col("chapter_seq").cast("long").alias("id"), "speaker")
    return V.passage(s, 2, 4)


def heading_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chapter's heading is its first segment's text, within white space; others have another or none."""
    rows = S.split_segments(H.chapters(spark, sf_dir))
    heading = F.expr("case when chapter_id % 3 = 0 then concat('  ', original_text, chr(10)) when chapter_id % 3 = 1 then 'Chapter One' end")
    return V.mark_headings(rows, rows.filter("id = 1").select("chapter_id", heading.alias("heading"))).select("chapter_id", "id", "kind", "speaker")


def even_aligner(chapter: int, words, start: float, end: float):
    """Every word takes a quarter of a second."""
    return [(i / 4, (i + 1) / 4, 0.5) for i in range(len(words))]


def anchored_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents aligned, the long ones in blocks; told by counts and sums of each one's words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chapter_id"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    out = W.aligned(d.withColumn("seconds", F.size("words") / 4.0), even_aligner, cells=1e6)
    return out.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("words"), F.max("end").alias("end"), F.sum("start").alias("starts"), F.sum(F.length("word")).alias("letters"))


def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.posexplode(W.word_blocks(F.expr(WORDS))).alias("block", "b"))
    return p.select("p_partkey", "block", "b.*")


def clip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.profile_clips(K.segments(spark, sf_dir), min_score=0.5, min_words=3).select("book_id", "book_seq")


QUERIES = {
    f.__name__: f
    for f in (
        voice_cast, profile_fallback, engine_routing, cast_assembly, cast_manifests, bank_by_emotion, manifest_entries, latest_clips, quote_speakers, worst_first,
        passage_slice, heading_marks, anchored_alignment, word_blocks, clip_profile,
    )
}

CAST = K.PRELUDE + f"""
, asked AS (SELECT DISTINCT chapter_number % 10 AS job_id, speaker, {ASSIGNED} AS voice FROM segments),
best AS (SELECT speaker AS voice, 'b' || book_seq || '.wav' AS file, kind AS text, align_score, duration_s FROM segments WHERE audio_start_s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY coalesce(align_score, 0) DESC, book_seq) = 1),
found AS (SELECT a.job_id, a.speaker, a.voice, a.speaker = 'Clara' AS preset, a.speaker = 'Clara Winslow' AS pin, b.* EXCLUDE (voice) FROM asked a LEFT JOIN best b USING (voice)),
done AS (SELECT job_id, speaker, CASE WHEN preset THEN 'qwen3-preset' END AS engine, CASE WHEN preset THEN 'Vivian' END AS preset, CASE WHEN pin THEN 'pin.wav' WHEN NOT preset THEN file END AS copied_from,
  CASE WHEN pin OR (NOT preset AND file IS NOT NULL) THEN replace(speaker, ' ', '_') || '.wav' END AS file, CASE WHEN pin THEN 'Hello' WHEN NOT preset THEN text END AS text,
  CASE WHEN pin THEN 0.5::DOUBLE WHEN NOT preset THEN align_score END AS align_score, CASE WHEN pin THEN 3.0::DOUBLE WHEN NOT preset THEN duration_s END AS duration_s,
  CASE WHEN preset THEN 'preset:Vivian' ELSE voice END AS source_voice, NOT preset AND voice = speaker AS own_voice FROM found)
"""

ORACLE_SQL = {
    "voice_cast": """
WITH s AS (SELECT n_regionkey AS cast, n_name AS speaker, unnest([['tts_service', 'xtts-v2'], ['speed', '1.' || n_nationkey], ['style_notes', 'calm: ' || n_nationkey]]) AS kv FROM nation)
SELECT "cast", speaker, kv[1] AS key, kv[2] AS value FROM s""",
    "profile_fallback": K.PRELUDE + "SELECT book_id, book_seq, speaker, CASE speaker WHEN 'Clara' THEN 'Vera' WHEN 'Marlow' THEN 'Otto' ELSE 'Ryan' END AS voice FROM segments",
    "engine_routing": f"""
SELECT p_partkey, {ENGINE} AS engine, CASE p_partkey % 4 WHEN 1 THEN 'qwen3-tts' ELSE 'xtts-v2' END AS routed, CASE p_partkey % 4 WHEN 1 THEN 'http://b:1,http://b:2' ELSE 'http://a:1' END AS urls FROM part""",
    "cast_assembly": CAST + "SELECT * FROM done",
    "cast_manifests": CAST + "SELECT job_id, CASE WHEN preset IS NULL THEN 'voicebank' ELSE 'cast' END AS manifest, speaker, file, preset FROM done WHERE preset IS NOT NULL OR file IS NOT NULL",
    "bank_by_emotion": """
WITH n AS (SELECT n_name, n_nationkey AS k, CASE WHEN n_nationkey * 3 % 10 > n_nationkey % 10 THEN 2 ELSE 0 END AS happy FROM nation),
a AS (SELECT *, unnest(['happy', 'sad', 'calm']) AS emotion FROM n)
SELECT n_name AS speaker, emotion, k || '_' || CASE WHEN emotion = 'happy' THEN happy WHEN k % 2 = 0 THEN 1 WHEN emotion = 'sad' THEN 1 ELSE happy END || '.wav' AS file FROM a""",
    "manifest_entries": """SELECT n_regionkey AS source, n_name || '.wav' AS name, n_name || ' "x"' AS text, CAST(n_nationkey AS DOUBLE) AS duration_s FROM nation""",
    "latest_clips": J.PRELUDE + """
SELECT job_id, id, CASE id % 3 WHEN 0 THEN stem || '.wav' WHEN 1 THEN stem || CASE WHEN id * 2 % 5 > id * 3 % 5 THEN '_a.wav' ELSE '_b.wav' END END AS file,
  CASE id % 3 WHEN 0 THEN 'there' WHEN 1 THEN 'latest' ELSE 'missing' END AS found FROM (SELECT job_id, id, printf('/w/%d/seg%04d', job_id, id) AS stem FROM j)""",
    "quote_speakers": """
WITH c AS (SELECT p_size, p_type, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_partkey % 4 <> 0 AND p_size % 3 <> 0 GROUP BY 1, 2),
w AS (SELECT p_size, p_type FROM c QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, first) = 1)
SELECT o_orderkey AS quote_start, o_orderkey + 10 AS quote_end, o_custkey % 60 AS character, p_type AS speaker, CASE WHEN o_orderkey % 2 = 0 THEN 'they' END AS mention, left(repeat(o_orderpriority, 40), 300) AS quote
FROM orders LEFT JOIN w ON p_size = o_custkey % 60""",
    "worst_first": J.PRELUDE + "SELECT job_id, id, align_score AS similarity, CASE WHEN length(text) % 11 >= 4 THEN 'failed' ELSE 'suspect' END AS status FROM j WHERE align_score < 0.5",
    "passage_slice": K.PRELUDE + "SELECT chapter_number AS chapter_id, chapter_seq AS id, speaker FROM segments WHERE chapter_seq BETWEEN 2 AND 4",
    "heading_marks": H.PRELUDE + """
SELECT chapter_id, id, CASE WHEN id = 1 AND chapter_id % 3 = 0 THEN 'heading' ELSE kind END AS kind, CASE WHEN id = 1 AND chapter_id % 3 = 0 THEN 'narrator' WHEN kind = 'narration' THEN 'narrator' ELSE 'unknown' END AS speaker FROM merged""",
    "anchored_alignment": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
SELECT doc_id AS chapter_id, len(w) AS words, len(w) / 4.0::DOUBLE AS "end", len(w) * (len(w) - 1) / 8.0::DOUBLE AS starts, list_sum([length(x) FOR x IN w]) AS letters FROM w WHERE len(w) > 0""",
    "word_blocks": f"""
WITH p AS (SELECT p_partkey, {WORDS} AS n FROM part),
b AS (SELECT *, CASE WHEN n <= 1200 THEN 1 ELSE CAST(ceil((n - 1200) / 1050.0::DOUBLE) AS INTEGER) + 1 END AS c FROM p WHERE n > 0),
r AS (SELECT *, unnest(range(0, c)) AS k FROM b)
SELECT p_partkey, CAST(k AS INTEGER) AS block, CAST(k * 1050 AS INTEGER) AS first, CAST(least(k * 1050 + 1200, n) AS INTEGER) AS last, CAST(CASE WHEN k = c - 1 THEN n ELSE (k + 1) * 1050 END AS INTEGER) AS kept FROM r""",
    "clip_profile": K.PRELUDE + "SELECT book_id, book_seq FROM segments WHERE kind = 'dialogue' AND audio_start_s IS NOT NULL AND align_score >= 0.5 AND word_count >= 3 AND duration_s BETWEEN 2.5 AND 15",
}
