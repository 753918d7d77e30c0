"""Columns for names, paths, requests and audio settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension.
MEDIA_TYPES = {"wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/aac"}


def voice_file_name(name: Column) -> Column:
    """A name of letters, digits, ``_`` and ``-`` only."""
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def safe_id(value: Column) -> Column:
    """The id; fails where it could lead out of its folder."""
    return F.when(F.contains(value, F.lit("/")) | F.contains(value, F.lit("..")), F.raise_error(F.concat(F.lit("unsafe id: "), value))).otherwise(value)


def is_under(path: Column, roots: list[str]) -> Column:
    """Whether a path without ``..`` lies in one of ``roots``."""
    out = F.lit(False)
    for root in roots:
        out = out | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    return out & ~path.rlike(r"(^|/)\.\.(/|$)")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def media_type(name: Column, types: Mapping[str, str] = MEDIA_TYPES, other: str = "application/octet-stream") -> Column:
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(other))


def stage_folder(number: Column, name: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit("-"), name)


def delivery(base: Column, phrase: Column) -> Column:
    """How to speak: the voice's manner, then the emotion's; null if there is neither."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(", ", some(base), some(phrase)), F.lit(""))


def tempo_steps(speed: Column) -> Column:
    """Factors of 0.5 or more whose product is ``speed``: array, empty where the tempo stays (1, or not in 0.25 to 4)."""
    slow = F.when(speed < 0.5, F.array(F.lit(0.5), speed / 0.5)).otherwise(F.array(speed))
    return F.when((speed != 1.0) & speed.between(0.25, 4.0), slow).otherwise(F.array().cast("array<double>"))


def gain_db(level: Column, target: float = -20.0, silence: float = -80.0) -> Column:
    """What loudness must rise by; 0 for silence."""
    return F.when(level > silence, F.lit(target) - level).otherwise(0.0)


def output_name(name: Column, fmt: str) -> Column:
    """A file name whose extension is ``fmt``; a name without one stays."""
    return F.when(name.rlike(r"^.+\.[^.]*$") & (extension(name) != fmt), F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(f".{fmt}"))).otherwise(name)


def byte_range(header: Column, size: Column) -> Column:
    """(start, end, status) of a range request ``bytes=a-b``; the end is clamped, and without a range it is the whole file."""
    a, b = F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", 2)
    asked = F.coalesce(a, F.lit("")) != ""
    end = F.least(F.coalesce(F.nullif(b, F.lit("")).cast("long"), size - 1), size - 1)
    return F.struct(F.when(asked, a.cast("long")).otherwise(0).alias("start"), F.when(asked, end).otherwise(size - 1).alias("end"), F.when(asked, 206).otherwise(200).alias("status"))


def token_states(words: Column) -> Column:
    """States of an alignment of ``words``: two for each letter, and one."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)) * 2 + 1


def encoder_windows(seconds: Column, window: float = 60.0, overlap: float = 6.0) -> Column:
    """Array of (start, end, keep_from, keep_to) of overlapping windows; half of an overlap is dropped at inner edges."""
    hop = window - overlap
    count = F.when(seconds <= window, 1).otherwise(F.ceil((seconds - window) / hop).cast("int") + 1)
    start = lambda i: i.cast("double") * hop
    end = lambda i: F.least(start(i) + window, seconds)
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            start(i).alias("start"), end(i).alias("end"), F.when(i == 0, 0.0).otherwise(start(i) + overlap / 2).alias("keep_from"), F.when(i == count - 1, seconds).otherwise(end(i) - overlap / 2).alias("keep_to")
        ),
    )


def is_speakable(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def default_voice(speaker: Column, place: Column, voices: list[str]) -> Column:
    """The voice of the speaker's own name, whatever its case, else the one at the speaker's place, going round."""
    every = F.array(*[F.lit(v) for v in voices])
    own = F.get(F.filter(every, lambda v: F.lower(v) == F.lower(speaker)), F.lit(0))
    return F.coalesce(own, F.get(every, F.pmod(place, F.lit(len(voices))).cast("int")))


def voice_request(engine: Column, voice: Column) -> Column:
    """(engine, preset, reference): preset engines get the voice's name, others the path of its clip."""
    engine = F.coalesce(F.nullif(engine, F.lit("")), F.lit("xtts-v2"))
    preset = engine.startswith("qwen3")
    clip = F.concat(F.lit("/voices/xtts/"), F.coalesce(F.nullif(voice, F.lit("")), F.lit("generic_neutral.wav")))
    return F.struct(engine.alias("engine"), F.when(preset, voice).alias("preset"), F.when(~preset, clip).alias("reference"))


def block_id(group: Column, place: Column, base: int = 0, width: int = 10_000) -> Column:
    """Ids that are unique across groups of fewer than ``width``."""
    return (F.lit(base) + group.cast("long") * width + place).cast("long")
