"""Queries of lexicons, the stored phrase index, crawl order, keyed streams, calls of engines, versioned loads and files written and read back.

Each works on a whole given table; what a service would answer follows from the request, so that SQL can say it too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.catalog import corpora as K
from fabula.functions.lexicon import lexicon_of, replaced_in
from fabula.functions.spoken import held_text
from fabula.operators import corpus as C
from fabula.operators import crawl, reports, selection
from fabula.operators import production as P
from fabula.operators import segments as S
from fabula.operators.fulltext import PhraseIndex
from fabula.plans.calls import Engine, Engines, called
from fabula.sources import artifacts as A
from fabula.sources.tables import work_dir
from fabula.sources.versions import VersionedTable
from fabula.streaming import status as T


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with each word of four letters or more of the benchmark as a term (a table of fixed size, several thousand words)."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))).alias("term"))
    lexicon = lexicon_of(words.select("term", F.concat("term", F.lit("_")).alias("said")))
    return replaced_in(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("said")), "said", lexicon)


def phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all segments; chapters of every fifth number are renewed with other texts, one of eleven with nothing."""
    index = PhraseIndex(spark, work_dir(spark, "index"))
    s = K.segments(spark, sf_dir).select(*C.SEGMENT_KEY, "text")
    index.renew(s)
    index.renew(s.filter("chapter_number % 5 = 0").withColumn("text", F.expr("case when chapter_number % 11 <> 0 then concat('Of the ', text, ' of, the of') end")))
    return index.search("of the").unionByName(index.search("The of THE")).groupBy(*C.SEGMENT_KEY).agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("phrases"))


#: Stories of 20 pages: every sixth is a ring, every seventh goes on with the first page of the next, all others end.
NEXT = "case when page_id % 20 < 19 then page_id + 1 when (page_id div 20) % 6 = 5 then page_id - 19 when (page_id div 20) % 7 = 3 then page_id + 1 end"


def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.reading_order(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.expr(NEXT).alias("next")))


def _events(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return T.events_stream(spark, f"{path}*", spark.read.parquet(path).schema)  # a pattern, as a stream's path is else a folder


PHASE = "element_at(array('analyzing', 'synthesizing', 'verifying', 'done', 'error'), cast(event_id * 7 % 5 + 1 as int))"


def phase_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(PHASE).alias("phase"))
    return T.phases_stream(e, work_dir(spark, "phases"))


def render_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a stream of segments; the ledger knows a third of the orders, some with another fingerprint."""
    of = lambda df: df.select(F.col("l_suppkey").alias("job_id"), F.expr("l_partkey % 100").alias("id"), F.expr("concat('f', cast(l_quantity as bigint) div 10)").alias("fingerprint"))
    ledger = of(_table(spark, sf_dir, "lineitem")).filter("id % 3 = 0").groupBy("job_id", "id").agg(F.max("fingerprint").alias("fingerprint"))
    ledger = ledger.withColumn("clip", F.concat_ws("_", F.lit("old"), "job_id", "id"))
    return T.incremental_renders(of(_events(spark, sf_dir, "lineitem")), ledger, work_dir(spark, "renders"))


def assembly_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.expr("o_custkey % 40").alias("job_id"), F.col("o_orderkey").alias("id"))
    clip = lambda name: o.withColumn("clip", F.concat_ws("_", F.lit(name), "id"))
    return P.assembly_order(o, clip("kept").filter("id % 3 <> 0"), clip("new").filter("id % 5 = 0"))


def echo(replica: str, prompt: str) -> str:
    """An engine that says a text back, word by word from the end; texts of a length that 7 divides never get through."""
    if len(prompt) % 7 == 0:
        raise ConnectionError("reset")
    return " ".join(reversed(prompt.split(" ")))


def count(replica: str, prompt: str) -> str:
    return str(len(prompt))


def engine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every turn, by role: one engine for users, the default for those whose engine is not registered."""
    engines = Engines([Engine("echo", echo, ("a", "b"), frozenset({"words"}), 2), Engine("count", count, ("c", "d", "e"))], default="count")
    t = _table(spark, sf_dir, "conversations")
    rows = t.select("conv_id", "turn", F.expr("case role when 'user' then 'echo' when 'system' then null else ' other ' end").alias("engine"), F.coalesce("text", F.lit("")).alias("prompt"))
    rows = rows.withColumn("needs", F.when(F.col("engine") == "echo", F.array(F.lit("words"))))
    return called(rows, engines, attempts=2, pause_s=0.0).select("conv_id", "turn", "routed", F.md5("reply").alias("reply"), "calls", "error")


def versioned_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters loaded in three passes, one of them again and one that was left half done; then put together in one load."""
    table = VersionedTable(spark, work_dir(spark, "chapters"), "book_id int, chapter_number long, chapter_seq int, speaker string, words int", ("book_id", "chapter_number"))
    s = K.segments(spark, sf_dir).select(*C.SEGMENT_KEY, "speaker", F.col("word_count").alias("words"))
    table.load(s.filter("chapter_number % 2 = 0"), "even")
    s.filter("chapter_number % 3 = 0").write.parquet(f"{table.path}/loads/late")  # an attempt that did not get as far as to be listed
    table.load(s.filter("chapter_number % 3 = 0 and chapter_seq <= 2").withColumn("speaker", F.lit("again")), "late")
    table.load(s.filter("chapter_number % 2 = 0"), "even")
    table.load(s.filter("chapter_number % 2 = 1 and chapter_number % 3 > 0"), "odd")
    table.compacted("all")
    table.delete(["even", "late", "odd"])
    return table.read().groupBy("book_id", "chapter_number").agg(F.count(F.lit(1)).alias("segments"), F.sum("words").alias("words"), F.count_if(F.col("speaker") == "again").alias("again"))


def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters written as files by book and chapter, some of them anew, and read back with how they stand."""
    s = K.segments(spark, sf_dir).select(*C.SEGMENT_KEY, "kind", "speaker", "text")
    path = work_dir(spark, "chapters")
    A.write_chapter_table(s, path)
    A.write_chapter_table(s.filter("chapter_number % 4 = 0").withColumn("text", F.concat("text", F.lit("!"))), path)
    back = spark.read.schema(s.schema).parquet(path)
    aligned = K.segments(spark, sf_dir).filter("audio_start_s is not null and chapter_number % 3 = 0")
    state = A.load_state(back.filter("chapter_number % 7 <> 0"), aligned, s.select("chapter_number").distinct())
    return back.groupBy("book_id", "chapter_number").agg(F.count(F.lit(1)).alias("segments"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_seq", "text"))), lambda x: x["text"]), "|")).alias("texts")).join(state, "chapter_number")


def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as lines of JSON, read back with their types and counted by speaker; nulls are written, so every line has every field."""
    s = K.segments(spark, sf_dir).select("book_id", "book_seq", "speaker", "text", "audio_start_s", "align_score")
    path = work_dir(spark, "lines")
    A.write_json_lines(s, path)
    back = A.json_lines(spark, path, "book_id int, book_seq long, speaker string, text string, audio_start_s double, align_score double")
    return back.groupBy("book_id", "speaker").agg(F.count(F.lit(1)).alias("lines"), F.count("audio_start_s").alias("aligned"), F.sum(F.length("text")).alias("letters"))


def attribution_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with their speakers as lines of JSON (chapter, speaker, mention, quote), as a tab table and as delimited text."""
    s = K.segments(spark, sf_dir).filter("kind = 'dialogue'")
    rows = s.select(F.col("chapter_number").alias("chapter"), "speaker", F.expr("case when speaker <> 'unknown' then substring_index(speaker, ' ', 1) end").alias("mention"), F.regexp_replace("text", r"\s+", " ").alias("quote"))
    path = work_dir(spark, "attribution")
    A.write_json_lines(rows, f"{path}/json")
    A.write_manifest(rows, f"{path}/tab", sep="\t")
    kinds = "chapter long, speaker string, mention string, quote string"
    both = A.json_lines(spark, f"{path}/json", kinds).unionByName(A.tab_table(spark, f"{path}/tab", kinds)).unionByName(A.tab_table(spark, f"{path}/none", kinds))
    return both.groupBy("chapter", "speaker", "mention").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("quote")).alias("letters"))


def alias_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases stored, renewed by verdicts and applied again to segments that were loaded anew."""
    s = K.segments(spark, sf_dir)
    old = s.filter("kind <> 'heading' and speaker like '% %'").select("book_id", F.col("speaker").alias("alias")).distinct()
    stored = old.select("book_id", "alias", F.substring_index("alias", " ", -1).alias("canonical"), F.lit("suffix").alias("reason"), F.lit(1).cast("long").alias("evidence"))
    names = s.select("book_id", F.col("speaker").alias("alias")).distinct().filter("alias in ('Clara Winslow', 'Marlow')")
    new = names.select("book_id", "alias", F.lit("Clara").alias("canonical"), F.lit("llm").alias("reason"), F.lit(0).cast("long").alias("evidence"))
    aliases = C.store_aliases(stored, new, evidence=False)
    once = C.apply_aliases(s, aliases)
    return C.apply_aliases(once, aliases).groupBy("book_id", "speaker", "speaker_raw").agg(F.count(F.lit(1)).alias("lines"))


def migrated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as an earlier version stored them (text for numbers, a column too many, one too few), in today's columns."""
    s = K.segments(spark, sf_dir).select("book_id", F.col("book_seq").cast("string").alias("book_seq"), "speaker", F.lit("x").alias("old_note"), "duration_s")
    path = work_dir(spark, "old")
    s.write.parquet(path)
    out = A.with_schema(spark.read.parquet(path), "book_id long, book_seq long, speaker string, speaker_raw string, duration_s decimal(9,3)")
    return out.groupBy("book_id").agg(F.sum("book_seq").alias("places"), F.count("speaker_raw").alias("raw"), F.sum("duration_s").cast("double").alias("seconds"))


def subdued_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of each book from the most subdued down, and the seconds that each voice has."""
    m = K.segments(spark, sf_dir).filter("audio_start_s is not null").select("book_id", "book_seq", "speaker", "duration_s", "align_score", F.col("word_count").cast("double").alias("words"))
    ranked = selection.subdued_first(selection.z_profile(m, ["duration_s", "align_score", "words"]))
    return ranked.join(reports.voice_seconds(m, "speaker", "duration_s"), ["book_id", "speaker"]).select("book_id", "book_seq", "place", "voice_clips", "voice_seconds")


def stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of stages, of which some fields are state; what is left, in order of key."""
    e = _table(spark, sf_dir, "events")
    keys = {"status": F.col("event_type"), "at": F.col("ts").cast("string"), "artifact": F.lit("a.json"), "value": F.floor("value").cast("string"), "user": F.col("user_id").cast("string")}
    record = F.map_filter(F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), v)]), lambda key, value: (key != "value") | (F.col("event_id") % 3 > 0))
    said = F.transform(F.array_sort(F.map_entries(P.stage_details(record))), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return e.select("event_id", F.array_join(said, ",").alias("details"))


def analyser_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as an analysis hands them on, with the text that a renderer would take from them."""
    s = K.segments(spark, sf_dir).select(
        F.col("chapter_number").alias("chapter_id"), F.col("chapter_seq").alias("id"), "kind", "speaker", F.expr("case when book_seq % 5 > 0 then concat(' ', text, '  ') end").alias("original_text"),
        F.expr("case book_seq % 3 when 0 then '' when 1 then upper(kind) end").alias("spoken_text"), F.expr("if(book_seq % 4 = 0, null, 300)").alias("pause_before_ms"),
    )
    return S.analyser_lines(s).withColumn("held", held_text(F.col("original_text"), F.col("spoken_text"))).drop("original_text")


def cast_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cast_of(K.segments(spark, sf_dir))


def registry_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overrides(C.rebuild_characters(K.segments(spark, sf_dir), K.votes(spark, sf_dir)), K.registry(spark))


def flagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return P.flagged(o.select(F.expr("o_custkey % 40").alias("job_id"), F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey % 7 = 0, null, o_orderkey % 64 / cast(64 as double))").alias("similarity"), F.expr("o_custkey % 9").alias("words")))


def voice_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, asked in SQL."""
    C.aligned_view(K.segments(spark, sf_dir))
    return spark.sql("select book_id, speaker, speaker_raw, count(*) as clips, min(book_seq) as first, sum(word_count) as words from voice_corpus where kind = 'dialogue' group by 1, 2, 3")


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_replacement, phrase_index, crawl_order, phase_stream, render_stream, assembly_order, engine_calls, versioned_loads, chapter_files, segment_files, attribution_lines, alias_reload,
        migrated_segments, subdued_rank, stage_records, analyser_lines, cast_names, registry_overrides, flagged_segments, voice_corpus,
    )
}

_NEXT = NEXT.replace(" div ", " // ")
_PHASE = "['analyzing', 'synthesizing', 'verifying', 'done', 'error'][event_id * 7 % 5 + 1]"

ORACLE_SQL = {
    # Word by word: terms are single words, and no term is made by a replacement.
    "lexicon_replacement": r"""
WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{4,}')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM documents),
w AS (SELECT r, unnest(t) AS w, unnest(range(len(t))) AS i FROM d),
j AS (SELECT r, string_agg(CASE WHEN term IS NULL THEN w ELSE w || '_' END, '' ORDER BY i) AS said FROM w LEFT JOIN terms ON term = w GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(said, '') END AS said FROM d LEFT JOIN j USING (r)""",
    "phrase_index": K.PRELUDE + r"""
, now AS (SELECT book_id, chapter_number, chapter_seq, CASE WHEN chapter_number % 5 <> 0 THEN text WHEN chapter_number % 11 <> 0 THEN 'Of the ' || text || ' of, the of' ELSE '' END AS text FROM segments),
tok AS (SELECT * EXCLUDE (text), regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM now),
h AS (SELECT book_id, chapter_number, chapter_seq, len([k FOR k IN range(1, len(t)) IF t[k] = 'of' AND t[k + 1] = 'the']) AS a, len([k FOR k IN range(1, len(t) - 1) IF t[k] = 'the' AND t[k + 1] = 'of' AND t[k + 2] = 'the']) AS b FROM tok)
SELECT book_id, chapter_number, CAST(chapter_seq AS INTEGER) AS chapter_seq, a + b AS hits, CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS phrases FROM h WHERE a + b > 0""",
    # Back from the ends; what no end reaches is led forward for as many steps as there are pages in its story and the next.
    "crawl_order": f"""
WITH RECURSIVE l AS (SELECT page_id AS page, {_NEXT} AS "next" FROM pages), k AS (SELECT l.page, n.page AS "next" FROM l LEFT JOIN l n ON n.page = l."next"),
back AS (SELECT page, page AS last, CAST(0 AS BIGINT) AS "left" FROM k WHERE "next" IS NULL UNION ALL SELECT k.page, b.last, b."left" + 1 FROM back b JOIN k ON k."next" = b.page),
lost AS (SELECT page, "next" FROM k ANTI JOIN back USING (page)),
fore AS (SELECT page, "next" AS pos FROM lost UNION SELECT f.page, x."next" FROM fore f JOIN lost x ON x.page = f.pos)
SELECT page, last, "left", max("left") OVER (PARTITION BY last) - "left" + 1 AS place, false AS on_ring FROM back
UNION ALL SELECT page, NULL, NULL, NULL, bool_or(pos = page) FROM fore GROUP BY 1""",
    "phase_stream": f"""
WITH e AS (SELECT user_id AS job_id, event_id, {_PHASE} AS phase FROM events)
SELECT job_id, CASE WHEN max_by(phase, event_id) = 'error' THEN 'error' ELSE nullif(['', 'analyzing', 'synthesizing', 'verifying', 'done'][1 + max(list_position(['analyzing', 'synthesizing', 'verifying', 'done'], phase))], '') END AS phase, count(*) AS events FROM e GROUP BY 1""",
    "render_stream": """
WITH s AS (SELECT l_suppkey AS job_id, l_partkey % 100 AS id, 'f' || CAST(l_quantity AS BIGINT) // 10 AS fingerprint FROM lineitem),
ledger AS (SELECT job_id, id, max(fingerprint) AS was FROM s WHERE id % 3 = 0 GROUP BY 1, 2),
o AS (SELECT s.*, was, row_number() OVER w AS k, lag(fingerprint) OVER w AS before FROM s LEFT JOIN ledger USING (job_id, id) WINDOW w AS (PARTITION BY job_id, id ORDER BY fingerprint)),
d AS (SELECT *, coalesce(fingerprint = CASE WHEN k = 1 THEN was ELSE before END, false) AS reuse FROM o),
n AS (SELECT *, count(*) FILTER (NOT reuse) OVER (PARTITION BY job_id, id ORDER BY k) AS fresh FROM d)
SELECT job_id, id, fingerprint, CASE WHEN reuse THEN 'reuse' ELSE 'todo' END AS action, CASE WHEN reuse THEN CASE WHEN fresh > 0 THEN 'new_' ELSE 'old_' END || job_id || '_' || id END AS clip FROM n""",
    "assembly_order": """
SELECT o_custkey % 40 AS job_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INTEGER) AS place, CASE WHEN o_orderkey % 5 = 0 THEN 'new_' ELSE 'kept_' END || o_orderkey AS clip, o_orderkey % 5 = 0 AS fresh
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0""",
    "engine_calls": """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), c AS (SELECT *, role = 'user' AND length(t) % 7 = 0 AS lost FROM t)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'echo' ELSE 'count' END AS routed, CASE WHEN lost THEN NULL WHEN role = 'user' THEN md5(array_to_string(list_reverse(string_split(t, ' ')), ' ')) ELSE md5(CAST(length(t) AS VARCHAR)) END AS reply,
  CASE WHEN lost THEN 2 ELSE 1 END AS calls, CASE WHEN lost THEN 'ConnectionError: reset' END AS error FROM c""",
    "versioned_loads": K.PRELUDE + """
SELECT book_id, chapter_number, count(*) AS segments, CAST(sum(word_count) AS BIGINT) AS words, count(*) FILTER (chapter_number % 3 = 0) AS again FROM segments WHERE chapter_number % 3 > 0 OR chapter_seq <= 2 GROUP BY 1, 2""",
    "chapter_files": K.PRELUDE + """
, c AS (SELECT book_id, chapter_number, count(*) AS segments, md5(string_agg(CASE WHEN chapter_number % 4 = 0 THEN text || '!' ELSE text END, '|' ORDER BY chapter_seq)) AS texts, count(audio_start_s) AS timed FROM segments GROUP BY 1, 2)
SELECT book_id, chapter_number, segments, texts, CASE WHEN chapter_number % 7 = 0 THEN 'skipped_no_segments' WHEN chapter_number % 3 > 0 OR timed = 0 THEN 'not_aligned' ELSE 'loaded' END AS state FROM c""",
    "segment_files": K.PRELUDE + "SELECT book_id, speaker, count(*) AS lines, count(audio_start_s) AS aligned, CAST(sum(length(text)) AS BIGINT) AS letters FROM segments GROUP BY 1, 2",
    "attribution_lines": K.PRELUDE + r"""
SELECT chapter_number AS chapter, speaker, CASE WHEN speaker <> 'unknown' THEN split_part(speaker, ' ', 1) END AS mention, 2 * count(*) AS lines, CAST(2 * sum(length(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS BIGINT) AS letters
FROM segments WHERE kind = 'dialogue' GROUP BY 1, 2, 3""",
    "alias_reload": K.PRELUDE + """
, a AS (SELECT DISTINCT book_id, speaker AS alias FROM segments WHERE (kind <> 'heading' AND contains(speaker, ' ')) OR speaker IN ('Clara Winslow', 'Marlow'))
SELECT s.book_id, CASE WHEN a.alias IS NULL THEN speaker WHEN alias IN ('Clara Winslow', 'Marlow') THEN 'Clara' ELSE string_split(alias, ' ')[-1] END AS speaker, a.alias AS speaker_raw, count(*) AS lines
FROM segments s LEFT JOIN a ON a.book_id = s.book_id AND a.alias = s.speaker GROUP BY ALL""",
    "stage_records": """
SELECT event_id, 'user=' || user_id || CASE WHEN event_id % 3 > 0 THEN ',value' || coalesce('=' || CAST(floor(value) AS BIGINT), '') ELSE '' END AS details FROM events""",
    "analyser_lines": K.PRELUDE + r"""
, a AS (SELECT chapter_number AS chapter_id, CAST(chapter_seq AS INTEGER) AS id, kind, CASE WHEN kind = 'dialogue' THEN speaker ELSE 'narrator' END AS speaker, CASE WHEN book_seq % 5 > 0 THEN ' ' || text || '  ' ELSE '' END AS o,
  CASE WHEN book_seq % 3 = 1 THEN upper(kind) END AS s, CASE WHEN book_seq % 4 = 0 THEN 0 ELSE 300 END AS pause_before_ms FROM segments)
SELECT chapter_id, id, kind, speaker, coalesce(s, o) AS spoken_text, pause_before_ms, regexp_replace(coalesce(nullif(o, ''), s, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS held FROM a""",
    "cast_names": K.PRELUDE + """
, f AS (SELECT book_id, speaker, min(book_seq) AS first FROM segments GROUP BY 1, 2)
SELECT book_id, speaker, CAST(row_number() OVER (PARTITION BY book_id ORDER BY speaker) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY book_id ORDER BY first, speaker) AS INTEGER) AS by_entrance FROM f""",
    "registry_overrides": K.PRELUDE + f"""
, c AS (SELECT DISTINCT book_id, speaker AS name FROM segments WHERE kind <> 'heading' AND speaker NOT IN ('narrator', 'unknown'))
SELECT c.book_id, count(*) AS gender_set FROM c JOIN {K.REGISTRY} ON r.book_id = c.book_id AND r.name = c.name WHERE gender IN ('male', 'female') AND confidence >= 0.6 GROUP BY 1""",
    "flagged_segments": """
WITH r AS (SELECT o_custkey % 40 AS job_id, o_orderkey AS id, CASE WHEN o_custkey % 9 >= 4 THEN 'failed' ELSE 'suspect' END AS verdict FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 64 / 64.0 < 0.85)
SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY verdict, id) AS INTEGER) AS place FROM r""",
    "voice_corpus": K.PRELUDE + """
SELECT book_id, speaker, CAST(NULL AS VARCHAR) AS speaker_raw, count(*) AS clips, min(book_seq) AS first, CAST(sum(word_count) AS BIGINT) AS words FROM segments WHERE audio_start_s IS NOT NULL AND kind = 'dialogue' GROUP BY 1, 2""",
    "migrated_segments": K.PRELUDE + "SELECT book_id, CAST(sum(book_seq) AS BIGINT) AS places, CAST(0 AS BIGINT) AS raw, CAST(sum(CAST(duration_s AS DECIMAL(9,3))) AS DOUBLE) AS seconds FROM segments GROUP BY 1",
    "subdued_rank": K.PRELUDE + """
, m AS (SELECT avg(duration_s) AS a1, stddev_pop(duration_s) AS s1, avg(align_score) AS a2, stddev_pop(align_score) AS s2, avg(word_count) AS a3, stddev_pop(word_count) AS s3 FROM segments WHERE audio_start_s IS NOT NULL),
z AS (SELECT s.*, round(-((duration_s - a1) / s1 + (align_score - a2) / s2 + (word_count - a3) / s3) / 3, 3) AS subdued FROM segments s, m WHERE audio_start_s IS NOT NULL),
v AS (SELECT book_id, speaker, count(*) AS voice_clips, round(sum(CAST(duration_s AS DECIMAL(18,3))), 1)::DOUBLE AS voice_seconds FROM segments WHERE audio_start_s IS NOT NULL GROUP BY 1, 2)
SELECT z.book_id, book_seq, CAST(row_number() OVER (PARTITION BY z.book_id ORDER BY subdued DESC, book_seq) AS INTEGER) AS place, voice_clips, voice_seconds FROM z JOIN v ON v.book_id = z.book_id AND v.speaker = z.speaker""",
}
