"""From segments to finished audio: casting, render plans, ledgers, timelines, status, quality reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.sources.tables import kept

# Preset voices by gender, the narrator's, and the one for unknown gender.
MALE = ("Ryan", "Dylan", "Eric", "Aiden", "Uncle_Fu")
FEMALE = ("Serena", "Vivian", "Sohee", "Ono_Anna")
NARRATOR, NEUTRAL = "Ryan", "Eric"
# Bank voices that are never lent.
PROTECTED = ("narrator", "Jason", "unknown", "default")
# What a render's fingerprint covers besides its text.
VOICE_FIELDS = ("emotion", "engine", "intensity", "speaker", "speed", "voice")


def _sql_array(values) -> str:
    said = lambda v: v.replace("\\", "\\\\").replace("'", "\\'")
    return "array(" + ", ".join(f"'{said(v)}'" for v in values) + ")"


def autocast(speakers: DataFrame) -> DataFrame:
    """Preset voices for the speakers (job_id, speaker, gender, voice) of each job; a voice that is given stays.

    Speakers are taken in order of name.  Each gets the next unused voice of their gender's pool, whose
    pointer moves on over used ones; once all are used, the pointer's voice again.  An unknown gender gets
    the neutral voice, else the first unused one.  The narrator's voice is kept from everyone else.  The
    fold holds one job's cast."""
    row = F.struct("speaker", "gender", "voice")
    jobs = speakers.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("cast"))
    jobs = jobs.withColumn("given", F.filter("cast", lambda x: x["voice"].isNotNull()))
    jobs = jobs.withColumn("asked", F.filter("cast", lambda x: x["voice"].isNull() & (x["speaker"] != "narrator")))
    jobs = jobs.withColumn("narrators", F.filter("cast", lambda x: x["speaker"] == "narrator"))
    own = f"coalesce(get(narrators, 0).voice, '{NARRATOR}')"
    zero = (
        f"named_struct('used', array_union(transform(given, x -> x.voice), array({own})), 'm', 0, 'f', 0, 'out', "
        f"concat(transform(given, x -> named_struct('speaker', x.speaker, 'voice', x.voice)), "
        f"transform(filter(narrators, x -> x.voice is null), x -> named_struct('speaker', 'narrator', 'voice', '{NARRATOR}'))))"
    )

    def pool_pick(pool, pointer: str) -> str:
        """(voice, pointer after) of the pool: how many voices are passed, then the first unused, else one more."""
        n, arr = len(pool), _sql_array(pool)
        order = f"transform(sequence(0, {n - 1}), k -> {arr}[(s.{pointer} + k) % {n}])"
        first = f"array_position(transform({order}, v -> not array_contains(s.used, v)), true)"
        return f"if({first} > 0, named_struct('v', {order}[int({first}) - 1], 'p', s.{pointer} + int({first})), named_struct('v', {arr}[s.{pointer} % {n}], 'p', s.{pointer} + {n} + 1))"

    # With all voices used the pointer has gone round once, so its voice is the one it started at.
    everyone = _sql_array((*MALE, *FEMALE))
    free = f"coalesce(get(filter({everyone}, v -> not array_contains(s.used, v)), 0), '{NEUTRAL}')"
    neutral = f"if(array_contains(s.used, '{NEUTRAL}'), {free}, '{NEUTRAL}')"
    pick = (
        f"case x.gender when 'male' then {pool_pick(MALE, 'm')} when 'female' then {pool_pick(FEMALE, 'f')} else named_struct('v', {neutral}, 'p', 0) end"
    )
    step = (
        f"(s, x) -> element_at(transform(array({pick}), c -> named_struct('used', array_union(s.used, array(c.v)), 'm', if(x.gender = 'male', c.p, s.m), "
        "'f', if(x.gender = 'female', c.p, s.f), 'out', concat(s.out, array(named_struct('speaker', x.speaker, 'voice', c.v))))), 1)"
    )
    out = jobs.select("job_id", F.explode(F.expr(f"aggregate(asked, {zero}, {step}, s -> s.out)")).alias("c"))
    return out.select("job_id", "c.speaker", "c.voice")


#: Voices of a bank.
MAX_VOICES = 10_000


def stable_index(name: Column, count: Column | int) -> Column:
    """The first four bytes of the name's SHA-256, big-endian, modulo ``count``."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % count


def hashed_cast(speakers: DataFrame, bank: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Bank voices for the speakers (job_id, speaker): their own, the forced one, else a spare one found from
    a hash of the name onwards; spares are shared only when all are taken.  ``bank``: voice.  ``forced``:
    speaker, voice.  A job that needs a spare where there is none fails."""
    # One row: voices are recorded by hand.
    held = F.array_sort(F.collect_set("voice"))
    voices = bank.agg(F.when(F.size(held) > MAX_VOICES, F.raise_error(F.lit(f"more than {MAX_VOICES} bank voices"))).otherwise(held)).scalar()
    rows = speakers.select("job_id", "speaker").filter("speaker <> 'unknown'").distinct()
    if forced is not None:
        given = forced.join(bank.select("voice").distinct(), "voice", "left_semi").select("speaker", F.col("voice").alias("_forced"))
        rows = rows.join(given, "speaker", "left")
        lent = given.agg(F.array_sort(F.collect_set("_forced"))).scalar()
    else:
        rows, lent = rows.withColumn("_forced", F.lit(None).cast("string")), F.array().cast("array<string>")
    own = F.col("_forced").isNull() & F.array_contains(voices, F.col("speaker"))
    rows = rows.withColumn("_own", F.when(own, F.col("speaker")))
    jobs = rows.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("_forced", "_own").isNull(), F.col("speaker")))).alias("asked"), F.collect_list("_own").alias("matched"),
        F.collect_list(F.when(F.coalesce("_forced", "_own").isNotNull(), F.struct("speaker", F.coalesce("_forced", "_own").alias("voice")))).alias("fixed"),
    )
    spare = F.array_except(F.array_except(voices, F.concat(F.array(*[F.lit(v) for v in PROTECTED]), lent)), F.col("matched"))
    jobs = jobs.withColumn("lent", lent).withColumn("spare", F.sort_array(spare))
    none = (F.size("asked") > 0) & (F.size("spare") == 0)
    jobs = jobs.withColumn("spare", F.when(none, F.raise_error(F.lit("no spare voices in the bank"))).otherwise(F.col("spare")))
    start = "cast(cast(conv(substring(sha2(x, 256), 1, 8), 16, 10) as bigint) % size(spare) as int)"
    walk = f"transform(sequence(0, size(spare) - 1), k -> spare[({start} + k) % size(spare)])"
    pick = f"coalesce(get(filter({walk}, v -> not array_contains(s.taken, v)), 0), get(spare, {start}))"
    step = f"(s, x) -> element_at(transform(array({pick}), v -> named_struct('taken', array_union(s.taken, array(v)), 'out', concat(s.out, array(named_struct('speaker', x, 'voice', v))))), 1)"
    zero = "named_struct('taken', lent, 'out', cast(array() as array<struct<speaker:string,voice:string>>))"
    out = jobs.select("job_id", F.explode(F.concat("fixed", F.expr(f"aggregate(asked, {zero}, {step}, s -> s.out)"))).alias("c"))
    return out.select("job_id", "c.speaker", "c.voice")


def _json_text(value: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    names = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    out = F.regexp_replace(value, r'([\\"])', r"\\$1")
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + names.get(code, f"u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _json_number(value: Column) -> Column:
    """A JSON number in its shortest form: in figures from 1e-4 up to 1e16, else with an exponent of two digits or more."""
    shown, size = value.cast("string"), F.abs(value.cast("double"))
    figures = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(shown, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    exponent = F.concat(F.regexp_replace(F.regexp_extract(shown, "^([^E]+)E", 1), r"\.0$", ""), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(~F.contains(shown, F.lit("E")), shown).when((size >= 1e-4) & (size < 1e16), figures).otherwise(exponent)


def fingerprint(text: Column, **voice: Column) -> Column:
    """16 hex digits of the SHA-256 of canonical JSON (sorted keys) of a render's text and settings; nulls are left out."""
    parts = []
    for key in sorted((*voice, "text")):
        value = F.coalesce(text, F.lit("")) if key == "text" else voice[key]
        shown = _json_number(value) if key in ("intensity", "speed") else _json_text(value)
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{key}": '), shown)))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16)


def render_plan(segments: DataFrame, ledger: DataFrame, files: DataFrame, forced: DataFrame) -> DataFrame:
    """Which segments (job_id, id, fingerprint) need a render: reuse if the ledger (job_id, id, fingerprint, clip)
    has the same fingerprint, the clip is among ``files`` (clip) and the id not ``forced`` (job_id, id)."""
    have = ledger.select("job_id", "id", F.col("fingerprint").alias("_was"), "clip").join(files.select("clip", F.lit(True).alias("_there")), "clip", "left")
    force = forced.select("job_id", "id", F.lit(True).alias("_forced"))
    rows = segments.join(have, ["job_id", "id"], "left").join(force, ["job_id", "id"], "left")
    reuse = F.coalesce((F.col("_was") == F.col("fingerprint")) & F.col("_there") & F.col("_forced").isNull(), F.lit(False))
    return rows.select("job_id", "id", "fingerprint", F.when(reuse, "reuse").otherwise("todo").alias("action"), F.when(reuse, F.col("clip")).alias("clip"))


def ledger_state(events: DataFrame) -> DataFrame:
    """The latest record of each (job_id, id) from events (job_id, id, seq, fingerprint, clip); a null clip forgets it."""
    last = events.groupBy("job_id", "id").agg(F.max_by(F.struct("fingerprint", "clip"), "seq").alias("r"))
    return last.filter("r.clip is not null").select("job_id", "id", "r.fingerprint", "r.clip")


def redo(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """For each job of ``asked`` (job_id, id): ids that are forgotten, and those that had no clip."""
    known = ledger.select("job_id", "id", F.lit(True).alias("_k"))
    rows = asked.distinct().join(known, ["job_id", "id"], "left")
    pick = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("job_id").agg(pick(F.col("_k").isNotNull()).alias("forgotten"), pick(F.col("_k").isNull()).alias("unknown"))


def _lengths_after(pieces: list[tuple[int, int]], pause: int, long: int, overlap: int) -> list[tuple[int, int]]:
    """How a clip changes the length so far, after ``pieces``: (limit, add) says that lengths up to the limit (and over the one
    before) grow by so much.  A clip either adds the same to every length, or parts those that it can overlap from those it cannot."""
    if pause > 0 or overlap <= 0:
        return [(limit, add + pause + long) if pause > 0 else (limit, add + long) for limit, add in pieces]
    out: list[tuple[int, int]] = []
    low = -1
    for limit, add in pieces:
        cut = overlap - add
        for upto, grow in ((min(limit, cut), add + long), (limit, add - overlap + long)):
            if upto > low:
                if out and out[-1][1] == grow:
                    out[-1] = (upto, grow)
                else:
                    out.append((upto, grow))
                low = upto
    return out


#: Longer than any audio.
ENDLESS = (1 << 62) - 1


def timeline(clips: DataFrame, crossfade_ms: int = 50) -> DataFrame:
    """When each clip (job_id, id, pause_before_ms, duration_ms) starts in the assembled audio, and how long that is: job_id, id, start_ms, total_ms.

    A pause is silence before a clip; without one the clip overlaps the end of what stands there, if that
    is longer than the overlap.  So a start depends on the length so far, and a block of clips is a function of the length
    before it: a few pieces, on each of which a constant is added.  Clips are dealt out in ranges of (job, id); each task
    puts its ranges' functions together; those of a job are applied one after another, a row for each range; then all ranges
    are filled in at the same time.  No job, however long, is in one task.

    Missing pauses and durations count as 0.  Of clips with one id, the one with the shorter pause, then the shorter itself, comes first.
    Clips without a job take no part.
    """
    kind = clips.schema["job_id"].dataType.simpleString()
    ms = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = clips.filter("job_id is not null").select("job_id", F.col("id").cast("long").alias("id"), ms("pause_before_ms").alias("p"), ms("duration_ms").alias("d"))
    rows = kept(rows.repartitionByRange("job_id", "id", "p", "d").withColumn("range", F.spark_partition_id()), "clips")
    order = ["job_id", "range", "id", "p", "d"]

    def functions(batches):
        at, pieces = None, []
        for batch in batches:
            done = []
            for job, place, pause, long in zip(batch["job_id"].tolist(), batch["range"].tolist(), batch["p"].tolist(), batch["d"].tolist(), strict=True):
                if at != (job, place):
                    if at is not None:
                        done.append((*at, [x for x, _ in pieces], [x for _, x in pieces]))
                    at, pieces = (job, place), [(ENDLESS, 0)]
                pieces = _lengths_after(pieces, pause, long, crossfade_ms)
            yield pd.DataFrame(done, columns=["job_id", "range", "limits", "adds"])
        if at is not None:
            yield pd.DataFrame([(*at, [x for x, _ in pieces], [x for _, x in pieces])], columns=["job_id", "range", "limits", "adds"])

    def applied(batches):
        job, length, own, out = None, 0, [], []
        for batch in batches:
            for now, place, limits, adds in zip(*[batch[c].tolist() for c in ("job_id", "range", "limits", "adds")], strict=True):
                if own and now != job:
                    out += [(*x, length) for x in own]
                    length, own = 0, []
                job = now
                own.append((job, place, length))
                length += int(adds[next(k for k, limit in enumerate(limits) if length <= limit)])
            yield pd.DataFrame(out, columns=["job_id", "range", "before", "total_ms"])
            out = []
        yield pd.DataFrame([(*x, length) for x in own], columns=["job_id", "range", "before", "total_ms"])

    def filled(batches):
        at, length = None, 0
        for batch in batches:
            starts = []
            for job, place, before, pause, long in zip(*[batch[c].tolist() for c in ("job_id", "range", "before", "p", "d")], strict=True):
                if at != (job, place):
                    at, length = (job, place), before
                start = length + pause if pause > 0 else length - crossfade_ms if length > crossfade_ms > 0 else length
                length = start + long
                starts.append(start)
            yield pd.DataFrame({"job_id": batch["job_id"], "id": batch["id"], "start_ms": starts, "total_ms": batch["total_ms"]})

    blocks = rows.repartition("job_id", "range").sortWithinPartitions(*order).mapInPandas(functions, f"job_id {kind}, range int, limits array<long>, adds array<long>")
    ranges = blocks.repartition("job_id").sortWithinPartitions("job_id", "range")  # a row for each range of a job; many jobs in one call
    before = ranges.mapInPandas(applied, f"job_id {kind}, range int, before long, total_ms long")
    placed = rows.join(before.hint("merge"), ["job_id", "range"]).sortWithinPartitions(*order)
    return placed.mapInPandas(filled, f"job_id {kind}, id long, start_ms long, total_ms long")


def assembly_order(segments: DataFrame, reused: DataFrame, rendered: DataFrame) -> DataFrame:
    """The clips that a job is assembled from, in reading order: job_id, id, place (from 1), clip, fresh.

    ``segments``: job_id, id.  ``reused`` and ``rendered``: job_id, id, clip; a render replaces what would have been reused, and
    of several the greatest clip counts.  Segments without a clip are left out, and the places close up."""
    tagged = lambda df, fresh: df.filter("clip is not null").select("job_id", "id", F.struct(F.lit(fresh).alias("fresh"), "clip").alias("c"))
    both = tagged(reused, False).unionByName(tagged(rendered, True)).groupBy("job_id", "id").agg(F.max("c").alias("c"))
    rows = segments.select("job_id", "id").distinct().join(both, ["job_id", "id"])
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("id"))
    return rows.select("job_id", "id", place.alias("place"), "c.clip", "c.fresh")


def segment_view(segments: DataFrame, qa: DataFrame, ledger: DataFrame, failed: bool = False, speaker: str | None = None) -> DataFrame:
    """Segments with their verdict and clip, optionally those that failed or are suspect, or one speaker's."""
    out = segments.join(qa.select("job_id", "id", "similarity", "status"), ["job_id", "id"], "left").join(ledger.select("job_id", "id", "clip"), ["job_id", "id"], "left")
    if failed:
        out = out.filter(F.col("status").isin("failed", "suspect"))
    return out.filter(F.col("speaker") == speaker) if speaker else out


def job_summary(log: DataFrame, ledger: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Latest status of each stage of each job (``not run`` where it has none), and its clips."""
    last = log.groupBy("job_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    wide = last.groupBy("job_id").pivot("stage", list(stages)).agg(F.first("status")).fillna("not run", list(stages))
    clips = ledger.groupBy("job_id").agg(F.count(F.lit(1)).alias("clips"))
    return wide.join(clips, "job_id", "left").fillna(0, ["clips"])


def latest_status(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("e"), F.count(F.lit(1)).alias("events")).select(key, "events", *[f"e.{c}" for c in columns])


def quality_report(results: DataFrame, threshold: float = 0.85, min_words: int = 4) -> DataFrame:
    """Checked, passed, failed and suspect segments of each job, mean similarity, and those without audio.

    ``results``: job_id, id, similarity (null: no audio), words.  The threshold meets the unrounded score."""
    s = F.col("similarity")
    low = s < threshold
    return results.groupBy("job_id").agg(
        F.count("similarity").alias("checked"), F.count_if(s >= threshold).alias("passed"), F.count_if(low & (F.col("words") >= min_words)).alias("failed"),
        F.count_if(low & (F.col("words") < min_words)).alias("suspect"), F.count_if(s.isNull()).alias("missing"),
        F.round(F.coalesce(F.avg(F.round(s, 4)), F.lit(0.0)), 4).alias("mean_similarity"),
    )


def flagged(results: DataFrame, threshold: float = 0.85, min_words: int = 4) -> DataFrame:
    """Segments to be rendered again, failed ones before suspect ones: job_id, id, verdict, place (from 1 in each job)."""
    low = results.filter(F.col("similarity") < threshold)
    failed, suspect = low.filter(F.col("words") >= min_words), low.filter(F.col("words") < min_words)
    both = failed.select("job_id", "id", F.lit("failed").alias("verdict")).unionByName(suspect.select("job_id", "id", F.lit("suspect").alias("verdict")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("verdict", "id")))


#: What a stage's record says of the stage itself, and not of its work.
STAGE_STATE = ("status", "at", "artifact")


def stage_details(record: Column) -> Column:
    """What a stage recorded (a map) besides its state."""
    return F.map_filter(record, lambda key, _: ~key.isin(*STAGE_STATE))


def best_take(takes: DataFrame, enough: float = 0.95, rerolls: int = 3) -> DataFrame:
    """The take that stays of each (job_id, id): takes (attempt from 0, score) count until the best so far is
    ``enough``; only a strictly better one replaces it."""
    order = Window.partitionBy("job_id", "id").orderBy("attempt")
    best_before = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = takes.filter(F.col("attempt") <= rerolls).withColumn("_b", best_before).filter(F.coalesce(F.col("_b") < enough, F.lit(True)))
    out = rows.groupBy("job_id", "id").agg(F.max_by("score", F.struct("score", -F.col("attempt"))).alias("score"), F.max_by("attempt", F.struct("score", -F.col("attempt"))).alias("attempt"), F.min_by("score", "attempt").alias("before"), F.count(F.lit(1)).alias("tried"))
    return out.withColumn("improved", F.col("score") > F.col("before"))


def bench_stats(runs: DataFrame) -> DataFrame:
    """Per case: segments, seconds, audio, real-time factor, upper median and longest.

    Times are counted by value first; the median is the first value whose running count goes beyond half."""
    per = runs.groupBy("case", "elapsed_s").agg(F.count(F.lit(1)).alias("n"), F.sum("audio_s").alias("audio_s"))
    timed = F.when(F.col("elapsed_s").isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(timed).over(Window.partitionBy("case").orderBy("elapsed_s").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum(timed).over(Window.partitionBy("case"))
    per = per.withColumn("upper", upto > F.floor(every / 2))
    out = per.groupBy("case").agg(
        F.sum("n").alias("segments"), F.round(F.sum(F.col("elapsed_s") * F.col("n")), 3).alias("wall_s"), F.round(F.sum("audio_s"), 3).alias("audio_s"),
        F.min(F.when(F.col("upper"), F.col("elapsed_s"))).alias("median_s"), F.max("elapsed_s").alias("max_s"),
    )
    return out.select("case", "segments", "wall_s", "audio_s", F.round(F.col("wall_s") / F.col("audio_s"), 3).alias("rtf"), "median_s", "max_s")
