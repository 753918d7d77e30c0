"""Readers and writers of the files between the steps of a book's production, all with explicit schemas."""

from __future__ import annotations

import io
import wave
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from fabula.sources.tables import Folder, kept

SEGMENTS = (
    "segments array<struct<id:int,kind:string,speaker:string,text:string,attribution_source:string,char_offset_start:int,char_offset_end:int>>, "
    "characters array<struct<name:string,gender:string,male_votes:int,female_votes:int>>"
)
ALIGNMENT = (
    "chapter int, audio_offset_s double, word_count int, mean_score double, coverage double, "
    "words array<struct<word:string,segment_id:int,start:double,end:double,score:double>>, "
    "segments array<struct<segment_id:int,start:double,end:double,duration:double,words:int,mean_score:double>>"
)
#: Numbers of one book in a folder of a chapter table: a folder for each chapter takes the driver most of the time.
FOLDER_CHAPTERS = 1000
MARKERS = "chapters array<struct<start_time:string,end_time:string,tags:struct<title:string>>>"
MARKER_TITLE = r"(?i)^\s*Chapter\s+(\d+)\s*[:.\-–—]?\s*(.*)$"


def chapter_number(path: Column) -> Column:
    """The number in names such as ``ch007.json``."""
    return F.nullif(F.regexp_extract(path, r"ch(\d+)\.\w+$", 1), F.lit("")).cast("int")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("chapter_number", chapter_number(F.col("_metadata.file_path")))


def chapter_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of chapter files ``chNNN.json``: chapter_number and the fields of a segment."""
    return _json(spark, path, SEGMENTS).select("chapter_number", F.explode("segments").alias("s")).select("chapter_number", "s.*")


def chapter_votes(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, SEGMENTS).select("chapter_number", F.explode("characters").alias("c")).select("chapter_number", "c.*")


def aligned_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of alignment files in order: chapter_number, segment_id, idx (within the segment), word, start, end, score."""
    rows = _json(spark, path, ALIGNMENT).select("chapter_number", "audio_offset_s", F.expr("explode(transform(words, (w, i) -> struct(i as place, w)))").alias("x"))
    rows = rows.select("chapter_number", "audio_offset_s", "x.place", "x.w.*")
    order = Window.partitionBy("chapter_number", "segment_id").orderBy("place")
    shifted = lambda c: F.round(F.col(c) + F.coalesce("audio_offset_s", F.lit(0.0)), 3)
    return rows.select("chapter_number", "segment_id", (F.row_number().over(order) - 1).alias("idx"), "word", shifted("start").alias("start"), shifted("end").alias("end"), "score")


def aligned_spans(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, ALIGNMENT).select("chapter_number", "audio_offset_s", F.explode("segments").alias("s"))
    return rows.select("chapter_number", F.col("s.segment_id").alias("id"), "s.start", "s.end", "s.mean_score", "s.words", F.coalesce("audio_offset_s", F.lit(0.0)).alias("offset"))


def load_state(segments: DataFrame, spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """What a load would do with each of ``chapters`` (chapter_number): loaded, loaded without times, or skipped."""
    have = segments.select("chapter_number", F.lit(True).alias("_s")).distinct()
    timed = spans.select("chapter_number", F.lit(True).alias("_t")).distinct()
    out = chapters.join(have, "chapter_number", "left").join(timed, "chapter_number", "left")
    state = F.when(F.col("_s").isNull(), "skipped_no_segments").when(F.col("_t").isNull(), "not_aligned").otherwise("loaded")
    return out.select("chapter_number", state.alias("state"))


def markers(probe: Column) -> Column:
    """Chapter markers in a media probe's JSON, in order: array of (number, title, audio_start_s, audio_end_s); others are left out."""
    found = F.from_json(probe, MARKERS)["chapters"]
    said = F.filter(found, lambda c: F.coalesce(c["tags"]["title"], F.lit("")).rlike(MARKER_TITLE))
    one = lambda c: F.struct(
        F.regexp_extract(c["tags"]["title"], MARKER_TITLE, 1).cast("int").alias("number"), F.trim(F.regexp_extract(c["tags"]["title"], MARKER_TITLE, 2)).alias("title"),
        F.round(c["start_time"].cast("double"), 3).alias("audio_start_s"), F.round(c["end_time"].cast("double"), 3).alias("audio_end_s"),
    )
    return F.array_sort(F.transform(said, one))


def tab_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file with a header, columns by name; a file that is not there is an empty table."""
    try:
        wide = spark.read.option("sep", "\t").option("header", True).option("quote", '"').csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    kinds = spark.createDataFrame([], schema).schema
    return wide.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in wide.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def chapter_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole chapter files ``chNNN.txt``: chapter_number, text."""
    return spark.read.text(path, wholetext=True).select(chapter_number(F.col("_metadata.file_path")).alias("chapter_number"), F.col("value").alias("text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """A word a line, lower-cased; ``#`` starts a comment line."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` lines: key, phrase; others are comments."""
    line = F.trim("value")
    rows = spark.read.text(path).filter(~line.startswith("#") & F.contains("value", F.lit("=")))
    return rows.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("phrase"))


@F.pandas_udf(DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Length that a WAV file's header states; 0 for what is none."""

    def one(data: bytes) -> float:
        try:
            with wave.open(io.BytesIO(data)) as f:
                return f.getnframes() / f.getframerate()
        except (wave.Error, EOFError, ZeroDivisionError, TypeError):
            return 0.0

    return content.map(one)


def voice_files(spark: SparkSession, path: str, builtin: DataFrame) -> DataFrame:
    """WAV files under ``path`` in order of name: file, seconds, builtin (whether ``builtin`` (file) lists it)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), wav_seconds("content").alias("seconds"))
    return files.join(builtin.select("file", F.lit(True).alias("_b")), "file", "left").select("file", "seconds", F.coalesce("_b", F.lit(False)).alias("builtin")).orderBy("file")


def write_chapter_table(rows: DataFrame, path: str) -> None:
    """Write rows with book_id and chapter_number; only the chapters they hold are replaced.

    A folder holds ``FOLDER_CHAPTERS`` numbers of a book, and its name is one more column, ``chapters``, for whoever reads the
    table.  Of a folder that is written again, the other chapters are carried over."""
    spark, folder = rows.sparkSession, ["book_id", "chapters"]
    new = rows.withColumn("chapters", F.expr(f"chapter_number div {FOLDER_CHAPTERS}"))
    if any(n.startswith("book_id=") for n in Folder(spark, path).names(folders=True)):
        new = kept(new, "chapters")
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        held = spark.read.schema(StructType([new.schema[f.name] if f.name in folder else f for f in found])).parquet(path)
        for key, how in ((folder, "left_semi"), (["book_id", "chapter_number"], "left_anti")):
            own = new.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
            held = held.join(own, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), how)
        new = new.unionByName(held, allowMissingColumns=True)
    new.hint("rebalance", *folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_manifest(rows: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Delimited manifests: clips with a header and commas, training sets without and with bars."""
    rows.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def not_done(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose results are not there yet."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def voice_profiles(texts: DataFrame) -> DataFrame:
    """Settings of voice casts, rows (cast, text) of YAML with ``voices:``, names two spaces in and settings four:
    cast, speaker, key, value.  Comments, quotes around values and other top-level parts are left out.

    One row is one cast file, written by hand; its lines are read in order within that row."""
    line = F.regexp_replace("line", r"(^|\s+)#.*$|\s+$", "")
    rows = texts.select("cast", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).withColumn("line", line).filter("line <> ''")
    before = Window.partitionBy("cast").orderBy("at")
    part = F.last(F.nullif(F.regexp_extract("line", r"^(\S[^:]*):", 1), F.lit("")), ignorenulls=True).over(before)
    name = F.last(F.nullif(F.regexp_extract("line", r"""^ {2}["']?([^ "'][^:"']*)["']?:$""", 1), F.lit("")), ignorenulls=True).over(before)
    key, value = F.regexp_extract("line", r"^ {4}(\w+):\s*(.*)$", 1), F.regexp_extract("line", r"^ {4}(\w+):\s*(.*)$", 2)
    out = rows.select("cast", part.alias("part"), name.alias("speaker"), key.alias("key"), F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2").alias("value"))
    return out.filter("part = 'voices' and speaker is not null and key <> ''").drop("part")


def manifest_entries(texts: DataFrame, fields: str) -> DataFrame:
    """Entries of manifests that are one JSON object each, rows (source, text): source, name and the ``fields`` (DDL) of each."""
    kinds = F.from_json("text", f"map<string, struct<{fields}>>")
    return texts.select("source", F.explode(kinds).alias("name", "e")).select("source", "name", "e.*")


def bank_entries(texts: DataFrame) -> DataFrame:
    """Clips of voice bank manifests ``{"voices": {name: [clip, ...]}}``, rows (source, text): source, voice, place and the clip's fields."""
    kinds = F.from_json("text", "voices map<string, array<struct<file:string,text:string,align_score:double,duration_s:double,emotion:string>>>")
    rows = texts.select("source", F.explode(kinds["voices"]).alias("voice", "clips"))
    return rows.select("source", "voice", F.posexplode("clips").alias("place", "c")).select("source", "voice", "place", "c.*")


def backends(config: DataFrame) -> DataFrame:
    """Engines and their addresses from rows (text) of JSON ``{engine: url or [url, ...]}``: engine, urls."""
    rows = config.select(F.explode(F.from_json("text", "map<string, string>")).alias("engine", "said"))
    return rows.select("engine", F.when(F.col("said").startswith("["), F.from_json("said", "array<string>")).otherwise(F.array("said")).alias("urls"))


def with_schema(rows: DataFrame, schema: str) -> DataFrame:
    """A table written by an earlier version, with the columns of ``schema`` (DDL): those it lacks are null, others are left out."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
