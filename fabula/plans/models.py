"""Calls of language models: requests are rows, a client answers them inside the tasks, and replies are trusted only as far as they check out.

A client is any picklable function from the request's text to the reply's text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.operators import segments as S
from fabula.plans.calls import TRANSPORT
from fabula.sources.tables import kept

Client = Callable[[str], str]

# Emotions a model may give, and genders.
EMOTIONS = ("neutral", "happy", "sad", "angry", "fearful", "surprised", "disgusted", "excited", "calm")
GENDERS = ("male", "female", "unknown")


def asked(requests: DataFrame, client: Client, attempts: int = 1) -> DataFrame:
    """Add ``reply`` to ``requests`` (with ``prompt``): null where every attempt failed in transport.  A client's own mistakes end the job.

    Calls stay in the tasks that hold the requests, one at a time; ``calls.called`` spreads them over replicas."""
    fields = [*requests.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", reply string"

    def one(prompt: str) -> str | None:
        for _ in range(attempts):
            try:
                return client(prompt)
            except TRANSPORT:  # its batch is then left as it was
                continue
        return None

    def run(batches):
        for batch in batches:
            yield batch.assign(reply=pd.Series([one(p) for p in batch["prompt"]], index=batch.index, dtype=object))

    return requests.mapInPandas(run, schema)


def attribution_requests(segments: DataFrame, names: DataFrame, size: int = 20, around: int = 6) -> DataFrame:
    """A request for each batch of unresolved lines: chapter_id, batch, candidates, prompt.  ``names``: chapter_id, name."""
    batches = S.llm_batches(segments, size).select("chapter_id", "batch", F.explode("ids").alias("id"))
    lines = S.context_windows(segments, around).join(segments.select("chapter_id", "id", "original_text"), ["chapter_id", "id"]).join(batches, ["chapter_id", "id"])
    query = F.struct(F.col("id").alias("segment_id"), F.col("original_text").alias("dialogue_text"), "context")
    queries = lines.groupBy("chapter_id", "batch").agg(F.sort_array(F.collect_list(query)).alias("queries"))
    rows = queries.join(S.scene_candidates(segments, names, size=size), ["chapter_id", "batch"])
    prompt = F.to_json(F.struct(F.col("candidates").alias("character_names"), "queries"))
    return rows.select("chapter_id", "batch", "candidates", prompt.alias("prompt"))


def attribute_by_model(segments: DataFrame, names: DataFrame, client: Client, size: int = 20) -> DataFrame:
    """Give unresolved lines the speakers that ``client`` names, if they may be in the scene.

    Requests, their context and their scenes are all made from the segments, which are therefore written once."""
    segments = kept(segments, "attributed")
    replies = asked(attribution_requests(segments, names, size), client)
    said = F.from_json("reply", f"attributions array<struct<segment_id:{segments.schema['id'].dataType.simpleString()},speaker:string>>")["attributions"]
    rows = replies.select("chapter_id", "candidates", F.posexplode(said).alias("place", "a")).withColumn("who", F.trim("a.speaker"))
    rows = rows.groupBy("chapter_id", F.col("a.segment_id").alias("id")).agg(F.max_by(F.struct("who", "candidates"), "place").alias("x")).select("chapter_id", "id", "x.*")
    rows = rows.filter(F.array_contains("candidates", F.col("who")) & (F.lower("who") != "unknown")).select("chapter_id", "id", "who")
    out = segments.join(rows, ["chapter_id", "id"], "left")
    new = (F.col("kind") == "dialogue") & (F.col("speaker") == "unknown") & F.col("who").isNotNull()
    change = {"speaker": F.when(new, F.col("who")).otherwise(F.col("speaker")), "attribution_source": F.when(new, "ai").otherwise(F.col("attribution_source"))}
    return out.select(*[change[c].alias(c) if c in change else F.col(c) for c in segments.columns])


def emotions_by_model(segments: DataFrame, client: Client, size: int = 30) -> DataFrame:
    """Add ``emotion`` and ``intensity``: what ``client`` says of dialogue, if it is an emotion we know, else neutral and 0.5.

    A request holds ``size`` whole texts of a chapter."""
    spoken = segments.filter("kind = 'dialogue'")
    spoken = spoken.withColumn("batch", F.floor((F.row_number().over(S.per_chapter()) - 1) / size))
    item = F.struct("id", "speaker", F.col("original_text").alias("text"))
    requests = spoken.groupBy("chapter_id", "batch").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("prompt"))
    said = F.from_json("reply", "emotions array<struct<id:string,emotion:string,intensity:double>>")["emotions"]
    rows = asked(requests, client).select("chapter_id", F.posexplode(said).alias("place", "e"))
    ident = F.when(F.col("e.id").rlike("^-?[0-9]+$"), F.col("e.id").try_cast(segments.schema["id"].dataType))  # ids are as wide as the segments'
    rows = rows.withColumn("id", ident).filter(F.col("id").isNotNull() & F.col("e.emotion").isin(*EMOTIONS))
    rows = rows.groupBy("chapter_id", "id").agg(F.max_by("e", "place").alias("e"))
    rows = rows.select("chapter_id", "id", F.col("e.emotion").alias("_emotion"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("e.intensity", F.lit(0.5)))).alias("_intensity"))
    out = segments.drop("emotion", "intensity").join(rows, ["chapter_id", "id"], "left")
    said_of = lambda c, d: F.when(F.col("kind") == "dialogue", F.coalesce(c, F.lit(d))).otherwise(F.lit(d))
    return out.withColumn("emotion", said_of("_emotion", "neutral")).withColumn("intensity", said_of("_intensity", 0.5)).drop("_emotion", "_intensity")


def confidence(value: Column) -> Column:
    """Text as a number from 0 to 1; what is no number counts as 0."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def truth(value: Column) -> Column:
    """true, false, or null for what is neither."""
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def verdict(reply: Column) -> Column:
    """A model's verdict on a label: is_character, canonical, gender, confidence, reason.  A bare word for the
    gender is repaired; what cannot be read has confidence 0."""
    schema = "is_character string, canonical string, gender string, confidence string, reason string"
    mended = F.regexp_replace(reply, r'("gender"\s*:\s*)(male|female|unknown)\s*([,}])', r'$1"$2"$3')
    v = F.from_json(mended, schema)
    reason = F.when(reply.isNull(), "model call failed").otherwise(F.substring(F.coalesce(v["reason"], F.lit("")), 1, 300))
    return F.struct(
        truth(v["is_character"]).alias("is_character"), F.nullif(v["canonical"], F.lit("")).alias("canonical"),
        F.when(v["gender"].isin(*GENDERS), v["gender"]).otherwise("unknown").alias("gender"), confidence(v["confidence"]).alias("confidence"), reason.alias("reason"),
    )


def verdicts(evidence: DataFrame, client: Client, attempts: int = 2) -> DataFrame:
    """Ask ``client`` about each label of ``evidence`` (book_id, name, lines, and what is known): book_id, name, lines and its verdict."""
    requests = evidence.select("book_id", "name", "lines", F.to_json(F.struct(*evidence.columns)).alias("prompt"))
    return asked(requests, client, attempts).select("book_id", "name", "lines", verdict(F.col("reply")).alias("v")).select("book_id", "name", "lines", "v.*")


def clip_emotions(clips: DataFrame, client: Client, size: int = 25) -> DataFrame:
    """Emotions of clips (book_id, id, text) in batches; whatever is missing or unknown is neutral, 0.5."""
    lines = clips.select(F.col("book_id").alias("chapter_id"), "id", F.lit("dialogue").alias("kind"), F.lit("").alias("speaker"), F.col("text").alias("original_text"))
    said = emotions_by_model(lines, client, size)
    return said.select(F.col("chapter_id").alias("book_id"), "id", "emotion", "intensity")
