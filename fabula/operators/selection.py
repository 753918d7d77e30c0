"""Choosing clips: filters, spread samples, reference banks, training sets, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds added at either side of an exported clip.
PAD_S = 0.12


def select_clips(
    segments: DataFrame,
    book_id: int,
    speaker: str | None = None,
    kind: str | None = None,
    chapter: int | None = None,
    min_score: float = 0.0,
    min_words: int = 0,
    min_duration: float = 0.0,
    limit: int | None = None,
    spread: bool = False,
) -> DataFrame:
    """Aligned segments of a book; an argument that is empty or zero filters nothing.  ``spread`` takes
    ``limit`` rows evenly from the whole book instead of its first."""
    tests: list[Column] = [F.col("book_id") == book_id, F.col("audio_start_s").isNotNull()]
    if speaker:
        tests.append(F.col("speaker") == speaker)
    if kind:
        tests.append(F.col("kind") == kind)
    if chapter is not None:
        tests.append(F.col("chapter_number") == chapter)
    for column, least in (("align_score", min_score), ("word_count", min_words), ("duration_s", min_duration)):
        if least:
            tests.append(F.col(column) >= least)
    out = segments
    for t in tests:
        out = out.filter(t)
    if limit and spread:
        return spread_sample(out, limit, ["book_id"])
    return out.orderBy("book_seq").limit(limit) if limit else out


def spread_sample(rows: DataFrame, limit: int, group: list[str], order: str = "book_seq") -> DataFrame:
    """Of each group the rows at floor(i * n / limit), i < limit; all rows of groups that are not larger."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    counted = rows.withColumn("_place", place).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    # The only i that may lead to a row's place are the ceiling of place * limit / n and its neighbours.
    i = F.ceil(F.col("_place") * limit / F.col("_n"))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((i + d).between(0, limit - 1) & (F.floor((i + d).cast("double") * (F.col("_n") / F.lit(float(limit)))) == F.col("_place")))
    return counted.filter((F.col("_n") <= limit) | hit).drop("_place", "_n")


def clip_manifest(clips: DataFrame, fmt: str = "wav") -> DataFrame:
    safe = F.regexp_replace("speaker", "[ /]", "_")
    name = F.format_string(f"%s_ch%03d_seg%04d.{fmt}", safe, F.col("chapter_number").cast("int"), F.col("chapter_seq").cast("int"))
    return clips.select(
        name.alias("file"), "speaker", "chapter_number", "chapter_seq", F.round(F.greatest(F.lit(0.0), F.col("audio_start_s") - PAD_S), 3).alias("cut_start_s"),
        F.round(F.col("audio_end_s") + PAD_S, 3).alias("cut_end_s"), "duration_s", "align_score",
    )


def reference_clips(segments: DataFrame, min_score: float = 0.94, min_words: int = 10, low: float = 4.0, high: float = 12.0) -> DataFrame:
    """Clean clips: dialogue of known speakers, and the narrator's narration."""
    voice = ((F.col("kind") == "dialogue") & ~F.col("speaker").isin("unknown", "narrator")) | ((F.col("kind") == "narration") & (F.col("speaker") == "narrator"))
    good = F.col("audio_start_s").isNotNull() & (F.col("align_score") >= min_score) & (F.col("word_count") >= min_words) & F.col("duration_s").between(low, high)
    return segments.filter(voice & good)


def voice_bank(segments: DataFrame, per_character: int = 3, min_clips: int = 2, **limits: float) -> DataFrame:
    """Reference clips of each character with enough of them: book_id, speaker, clip, file, chapter_number, chapter_seq, duration_s."""
    clips = spread_sample(reference_clips(segments, **limits), per_character, ["book_id", "speaker"])
    who = Window.partitionBy("book_id", "speaker")
    clips = clips.withColumn("clip", F.row_number().over(who.orderBy("book_seq"))).withColumn("n", F.count(F.lit(1)).over(who)).filter(F.col("n") >= min_clips)
    name = F.format_string("%s_%02d.wav", F.regexp_replace("speaker", "[ /]", "_"), F.col("clip").cast("int"))
    return clips.select("book_id", "speaker", "clip", name.alias("file"), "chapter_number", "chapter_seq", "duration_s")


def training_set(segments: DataFrame, budget_s: float, min_score: float = 0.93, min_words: int = 4, low: float = 1.5, high: float = 15.0) -> DataFrame:
    """Clips in order of book and place until the next would exceed ``budget_s``.

    The running total is built from totals of chapters and then within each, so no task sums all clips."""
    good = segments.filter(F.col("audio_start_s").isNotNull() & (F.col("align_score") >= min_score) & (F.col("word_count") >= min_words) & F.col("duration_s").between(low, high))
    per = good.groupBy("book_id", "chapter_number").agg(F.sum("duration_s").alias("_s"))
    before = Window.orderBy("book_id", "chapter_number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chapter
    per = per.select("book_id", "chapter_number", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy("book_id", "chapter_number").orderBy("book_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = good.withColumn("_in", F.sum("duration_s").over(inside)).join(per, ["book_id", "chapter_number"])
    out = out.withColumn("total_s", F.round(F.col("_before") + F.col("_in"), 3)).filter(F.col("total_s") <= budget_s)
    return out.drop("_in", "_before")


def profile_clips(segments: DataFrame, min_score: float = 0.93, min_words: int = 8, low: float = 2.5, high: float = 15.0) -> DataFrame:
    """Aligned dialogue that is long and sure enough to measure a delivery by."""
    good = (F.col("align_score") >= min_score) & (F.col("word_count") >= min_words) & F.col("duration_s").between(low, high)
    return segments.filter((F.col("kind") == "dialogue") & F.col("audio_start_s").isNotNull() & good)


def z_profile(measures: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``subdued`` and ``intense``: minus and plus the mean of the columns' z-scores (deviation 0 counts as 1)."""
    stats = measures.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])).scalar()
    spread = lambda c: F.coalesce(F.nullif(stats[f"s_{c}"], F.lit(0.0)), F.lit(1.0))
    z = [(F.col(c) - stats[f"m_{c}"]) / spread(c) for c in columns]
    mean = sum(z[1:], z[0]) / len(z)
    return measures.select("*", F.round(-mean, 3).alias("subdued"), F.round(mean, 3).alias("intense"))


def subdued_first(profile: DataFrame) -> DataFrame:
    """Add ``place`` to clips with ``subdued``: from the most subdued of a book down, ties by order."""
    return profile.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("subdued"), "book_seq")))


def best_clip_per_emotion(clips: DataFrame, min_clips: int = 3, top: int = 8) -> DataFrame:
    """Of each (speaker, emotion) with enough clips the longest of its ``top`` best aligned; ties by order."""
    group = Window.partitionBy("speaker", "emotion")
    rows = clips.withColumn("n", F.count(F.lit(1)).over(group)).filter(F.col("n") >= min_clips)
    rows = rows.withColumn("by_score", F.row_number().over(group.orderBy(F.desc(F.coalesce("align_score", F.lit(0.0))), "book_seq"))).filter(F.col("by_score") <= top)
    rows = rows.withColumn("r", F.row_number().over(group.orderBy(F.desc(F.coalesce("duration_s", F.lit(0.0))), "by_score"))).filter("r = 1")
    return rows.select("speaker", "emotion", "n", "book_id", "book_seq", "align_score", "duration_s")
