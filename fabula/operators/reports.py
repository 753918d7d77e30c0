"""Totals that the steps of a production report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segmentation_summary(segments: DataFrame) -> DataFrame:
    """Per chapter: segments, dialogue, lines without a speaker, different speakers, and the share without one in percent."""
    spoken, nobody = F.col("kind") == "dialogue", F.col("speaker") == "unknown"
    out = segments.groupBy("chapter_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(spoken).alias("dialogue"), F.count_if(spoken & nobody).alias("unknown"),
        F.count_distinct(F.when(spoken & ~nobody, F.col("speaker"))).alias("characters"),
    )
    return out.withColumn("unattributed", F.round(100 * F.col("unknown") / F.greatest("segments", F.lit(1)), 1))


def extraction_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("book_id").agg(F.count_distinct("chapter_number").alias("chapters"), F.sum("word_count").cast("long").alias("words"), F.round(F.sum(F.coalesce("duration_s", F.lit(0.0))), 3).alias("seconds"))


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def production_report(clips: DataFrame) -> DataFrame:
    """Per job from clips (job_id, id, audio_s (null: failed), elapsed_s): synthesized, failed ids, audio minutes, real-time factor."""
    failed = F.array_sort(F.collect_list(F.when(F.col("audio_s").isNull(), F.col("id"))))
    out = clips.groupBy("job_id").agg(
        F.count("audio_s").alias("synthesized"), F.array_join(F.transform(failed, lambda x: x.cast("string")), ",").alias("failed"),
        F.coalesce(F.sum("audio_s"), F.lit(0.0)).alias("audio_s"), F.coalesce(F.sum("elapsed_s"), F.lit(0.0)).alias("elapsed_s"),
    )
    return out.select("job_id", "synthesized", "failed", F.round(F.col("audio_s") / 60, 2).alias("audio_minutes"), F.round(F.when(F.col("audio_s") > 0, F.col("elapsed_s") / F.col("audio_s")), 3).alias("rtf"))


def voice_seconds(clips: DataFrame, voice: str, seconds: str) -> DataFrame:
    """Clips and seconds (to a tenth) of each voice of a book; clips without a length count as 0 s."""
    total = F.round(F.sum(F.coalesce(F.col(seconds), F.lit(0)).cast("decimal(18,3)")), 1).cast("double")
    return clips.groupBy("book_id", voice).agg(F.count(F.lit(1)).alias("voice_clips"), total.alias("voice_seconds"))
