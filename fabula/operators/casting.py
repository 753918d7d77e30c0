"""Who is played by which engine, voice and clip: profiles with fallbacks, pins before the bank, manifests, lost files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The engine of pinned preset voices, and the profile of those who have none.
PRESET_ENGINE = "qwen3-preset"
DEFAULT_PROFILE = "default"


def with_profiles(lines: DataFrame, profiles: DataFrame, constant: str) -> DataFrame:
    """Add ``voice`` to ``lines`` (speaker): the speaker's profile (speaker, voice), else the one of
    ``default``, else ``constant``.  A profile without a voice counts as none; of repeated ones the least."""
    known = profiles.filter("voice is not null").groupBy("speaker").agg(F.min("voice").alias("_own"))
    default = known.filter(F.col("speaker") == DEFAULT_PROFILE).select("_own").agg(F.min("_own")).scalar()
    out = lines.join(known, "speaker", "left")
    return out.withColumn("voice", F.coalesce("_own", default, F.lit(constant))).drop("_own")


def routed(requests: DataFrame, backends: DataFrame, default: str) -> DataFrame:
    """Add ``routed`` and ``urls`` to ``requests`` (engine): the engine if ``backends`` (engine, urls) has it,
    else ``default``.  A request for an unknown engine fails if the default has no backend either."""
    known = backends.select(F.col("engine").alias("routed"), "urls")
    have = backends.select("engine", F.lit(True).alias("_known")).distinct()
    out = requests.join(have, "engine", "left").withColumn("routed", F.when(F.col("_known"), F.col("engine")).otherwise(F.lit(default)))
    lost = F.raise_error(F.concat(F.lit("no backend for engine "), F.coalesce("engine", F.lit("null")), F.lit(" and none for the default")))
    out = out.drop("_known").join(known.withColumn("_found", F.lit(True)), "routed", "left")
    return out.select(*requests.columns, F.when(F.col("_found"), F.col("routed")).otherwise(lost).alias("routed"), "urls")


def assembled_cast(assignment: DataFrame, bank: DataFrame, pins: DataFrame) -> DataFrame:
    """The reference of each (job_id, speaker, voice): a pinned preset, else a pinned clip, else the bank's best.

    ``bank``: voice, place, file, text, align_score, duration_s; best is the highest score (none counts as 0),
    ties to the first place.  ``pins``: speaker, engine, qwen_speaker, file, text, align_score, duration_s, one
    for each speaker.  A speaker with neither keeps a row without ``file``."""
    clip = F.struct("file", "text", "align_score", "duration_s")
    best = bank.groupBy("voice").agg(F.max_by(clip, F.struct(F.coalesce("align_score", F.lit(0.0)), -F.col("place"))).alias("_bank"))
    pinned = pins.select("speaker", F.coalesce(F.col("engine") == PRESET_ENGINE, F.lit(False)).alias("_preset"), "qwen_speaker", clip.alias("_pin"))
    out = assignment.join(best, "voice", "left").join(pinned, "speaker", "left")
    preset = F.coalesce("_preset", F.lit(False))
    pick = lambda c: F.when(~preset, F.when(F.col("_preset").isNotNull(), F.col(f"_pin.{c}")).otherwise(F.col(f"_bank.{c}"))).alias(c)
    named = F.concat(F.replace("speaker", F.lit(" "), F.lit("_")), F.lit(".wav"))
    source = pick("file")
    return out.select(
        "job_id", "speaker", F.when(preset, F.lit(PRESET_ENGINE)).alias("engine"), F.when(preset, F.col("qwen_speaker")).alias("preset"),
        source.alias("copied_from"), F.when(source.isNotNull(), named).alias("file"), pick("text"), pick("align_score"), pick("duration_s"),
        F.when(preset, F.concat(F.lit("preset:"), "qwen_speaker")).otherwise(F.col("voice")).alias("source_voice"), (~preset & (F.col("voice") == F.col("speaker"))).alias("own_voice"),
    )


def cast_manifests(cast: DataFrame) -> DataFrame:
    """Entries of a cast's two manifests, as rows (job_id, manifest, speaker, entry): clips with a file go to
    ``voicebank``, presets to ``cast``.  ``entry`` is JSON; one row for each speaker, so no job is gathered."""
    clip = F.to_json(F.struct("file", "text", "align_score", "duration_s", "source_voice", "own_voice"))
    route = F.to_json(F.struct("engine", F.col("preset").alias("qwen_speaker")))
    manifest = F.when(F.col("preset").isNotNull(), "cast").when(F.col("file").isNotNull(), "voicebank")
    out = cast.select("job_id", manifest.alias("manifest"), "speaker", F.when(F.col("preset").isNotNull(), route).otherwise(clip).alias("entry"))
    return out.filter("manifest is not null")


def best_by_emotion(bank: DataFrame) -> DataFrame:
    """For each (voice, emotion) of ``bank`` (voice, place, emotion, file, align_score) the best aligned clip, and
    for a voice without a neutral one its first emotion's as neutral: voice, emotion, file, align_score."""
    emotion = F.lower(F.coalesce(F.nullif("emotion", F.lit("")), F.lit("neutral")))
    rows = bank.withColumn("emotion", emotion).withColumn("align_score", F.coalesce("align_score", F.lit(0.0)))
    best = rows.groupBy("voice", "emotion").agg(F.max_by(F.struct("file", "align_score"), F.struct("align_score", -F.col("place"))).alias("c"), F.min("place").alias("place"))
    flat = best.groupBy("voice").agg(F.min_by("c", "place").alias("c"), F.bool_or(F.col("emotion") == "neutral").alias("has")).filter("not has")
    out = best.select("voice", "emotion", "c").unionByName(flat.select("voice", F.lit("neutral").alias("emotion"), "c"))
    return out.select("voice", "emotion", "c.file", "c.align_score")


def clip_for_line(lines: DataFrame, bank: DataFrame) -> DataFrame:
    """Add ``file`` to ``lines`` (speaker, emotion): the speaker's clip of that emotion, else the neutral one, else null."""
    best = best_by_emotion(bank)
    own = best.select(F.col("voice").alias("speaker"), "emotion", F.col("file").alias("_own"))
    flat = best.filter("emotion = 'neutral'").select(F.col("voice").alias("speaker"), F.col("file").alias("_flat"))
    return lines.join(own, ["speaker", "emotion"], "left").join(flat, "speaker", "left").select(*lines.columns, F.coalesce("_own", "_flat").alias("file"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolved_clips(clips: DataFrame, files: DataFrame) -> DataFrame:
    """Where each clip (job_id, id, path) is among ``files`` (path, modified): ``found`` is ``there``, ``latest``
    (the newest ``segNNNN_*.wav`` of its folder, ties to the greater name) or ``missing`` (``file`` is null)."""
    listed = files.groupBy("path").agg(F.max("modified").alias("modified"))
    stem = r"^seg(\d{4,})_[^/]*\.wav$"
    name = F.substring_index("path", "/", -1)
    takes = listed.filter(name.rlike(stem)).select(_folder(F.col("path")).alias("_in"), F.regexp_extract(name, stem, 1).alias("_id"), "path", "modified")
    newest = takes.groupBy("_in", "_id").agg(F.max_by("path", F.struct("modified", "path")).alias("_newest"))
    out = clips.join(listed.select("path", F.lit(True).alias("_there")), "path", "left")
    out = out.withColumn("_in", _folder(F.col("path"))).withColumn("_id", F.format_string("%04d", F.col("id").cast("long")))
    out = out.join(newest, ["_in", "_id"], "left")
    found = F.when(F.col("_there"), "there").when(F.col("_newest").isNotNull(), "latest").otherwise("missing")
    return out.select("job_id", "id", F.when(F.col("_there"), F.col("path")).otherwise(F.col("_newest")).alias("file"), found.alias("found"))


def canonical_names(mentions: DataFrame) -> DataFrame:
    """The most frequent proper name of each person: mentions (character, place, cat, prop, text) to character, speaker; ties to the first."""
    named = mentions.filter("cat = 'PER' and prop = 'PROP'").groupBy("character", "text").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return named.groupBy("character").agg(F.max_by("text", F.struct("n", -F.col("first"))).alias("speaker"))


def speakers_of_quotes(quotes: DataFrame, mentions: DataFrame, chars: int = 300) -> DataFrame:
    """Entries of a speakers file: quotes (quote_start, quote_end, character, mention, quote) with the speaker's
    canonical name where there is one; a quote is shown by its first ``chars`` letters."""
    out = quotes.join(canonical_names(mentions), "character", "left")
    return out.select("quote_start", "quote_end", "character", "speaker", "mention", F.left(F.coalesce("quote", F.lit("")), F.lit(chars)).alias("quote"))


def worst_first(results: DataFrame, threshold: float = 0.85, min_words: int = 4) -> DataFrame:
    """Results (job_id, id, similarity, words) under the threshold as ``failed`` or, if short, ``suspect``: job by
    job, the least similar first.  The sort goes over ranges, so a long list is no single task's."""
    low = results.filter(F.col("similarity") < threshold)
    status = F.when(F.col("words") >= min_words, "failed").otherwise("suspect")
    return low.select("job_id", "id", "similarity", status.alias("status")).orderBy("job_id", "status", "similarity", "id")


def passage(segments: DataFrame, first: int, last: int) -> DataFrame:
    """Segments ``first`` to ``last`` of each chapter, both counted from 1 and included."""
    return segments.filter(F.col("id").between(first, last))


def mark_headings(segments: DataFrame, headings: DataFrame) -> DataFrame:
    """A chapter's first segment becomes the narrator's heading where it is the one of ``headings`` (chapter_id, heading),
    white space around both aside.  A chapter without a heading, or with an empty one, stays as it is."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    known = headings.filter("heading <> ''").groupBy("chapter_id").agg(F.min("heading").alias("_heading"))
    is_one = F.coalesce((F.col("id") == 1) & (bare(F.col("original_text")) == bare(F.col("_heading"))), F.lit(False))
    new = {"kind": F.when(is_one, "heading").otherwise(F.col("kind")), "speaker": F.when(is_one, "narrator").otherwise(F.col("speaker"))}
    return segments.join(known, "chapter_id", "left").select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in segments.columns])
