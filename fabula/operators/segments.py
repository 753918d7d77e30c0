"""Chapter text to ordered, attributed, timed and speakable segments.

Every operator maps DataFrames to DataFrames.  A segment is a row keyed by (chapter_id, id); order is
always the column ``id``.  Chapters are independent, so all windows, groups and folds are per chapter
and none joins its input to itself: one shuffle by chapter_id serves a whole chain.  A chapter's lines
must fit one task, as its text is one value in the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fabula.functions.speech import COMMON_CAPITALS, is_spoken, named_speaker, pause_ms, pronoun_gender, quote_spans, span_text
from fabula.functions.spoken import compared_form, has_scene_break, spoken_text

#: Longest narration that merging may produce.
MAX_CHARS = 800


def per_chapter(*order: str | Column) -> WindowSpec:
    """A chapter's rows by ``order``."""
    return Window.partitionBy("chapter_id").orderBy(*(order or ("id",)))


def quote_segments(chapters: DataFrame) -> DataFrame:
    """(chapter_id, text) to one row for each span of dialogue or narration, not merged: chapter_id, id,
    kind, original_text, speaker, attribution_source, paragraph_index, char_offset_start, char_offset_end."""
    return paragraph_segments(chapters.select("chapter_id", F.posexplode(F.split("text", "\n", -1)).alias("paragraph_index", "p")))


def paragraph_segments(paragraphs: DataFrame) -> DataFrame:
    """The same from (chapter_id, paragraph_index, p), paragraphs numbered from 0."""
    spans = paragraphs.select("chapter_id", "paragraph_index", F.posexplode(quote_spans(F.col("p"))).alias("place", "span"))
    # Spans tile their paragraphs and one newline follows each, so offsets are sums over the chapter.
    before = per_chapter("paragraph_index", "place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("span")).over(before), F.lit(0)) + F.col("paragraph_index")
    spans = spans.select("*", start.cast("int").alias("start"), span_text(F.col("span")).alias("original_text")).filter("original_text <> ''")
    kind = F.when(is_spoken(F.col("span")), "dialogue").otherwise("narration")
    return spans.select(
        "chapter_id",
        F.row_number().over(per_chapter("paragraph_index", "place")).alias("id"),
        kind.alias("kind"),
        "original_text",
        F.when(kind == "narration", "narrator").otherwise("unknown").alias("speaker"),
        F.lit("none").alias("attribution_source"),
        "paragraph_index",
        F.col("start").alias("char_offset_start"),
        (F.col("start") + F.length("span")).alias("char_offset_end"),
    )


def merge_narration(segments: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Join runs of narration with newlines while the result stays within ``max_chars``; ids are given anew.

    A run of narration between two lines of dialogue is folded over its lengths alone, which gives where
    its merged segments begin; each of them is then joined from its lines at once."""
    spoken = F.col("kind") != "narration"
    run = F.sum(spoken.cast("int")).over(per_chapter().rowsBetween(Window.unboundedPreceding, 0))
    part = F.struct("id", "original_text", "paragraph_index", "char_offset_start", "char_offset_end")
    runs = segments.withColumn("run", run).groupBy("chapter_id", "run", spoken.alias("spoken"), F.when(spoken, F.col("id")).alias("one")).agg(
        F.first("kind").alias("kind"), F.first("speaker").alias("speaker"), F.first("attribution_source").alias("attribution_source"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    begins = (
        "aggregate(transform(parts, x -> length(x.original_text)), named_struct('i', 0, 'chars', -1, 'at', cast(array() as array<int>)), (s, n) -> "
        f"if(s.chars >= 0 and s.chars + n + 1 <= {max_chars}, named_struct('i', s.i + 1, 'chars', s.chars + n + 1, 'at', s.at), "
        "named_struct('i', s.i + 1, 'chars', n, 'at', concat(s.at, array(s.i)))), s -> concat(s.at, array(s.i)))"
    )
    joined = (
        "transform(transform(array({b}), b -> transform(sequence(0, size(b) - 2), k -> slice(parts, b[k] + 1, b[k + 1] - b[k])))[0], m -> named_struct('id', m[0].id, "
        "'original_text', array_join(transform(m, x -> x.original_text), '\n'), 'paragraph_index', m[0].paragraph_index, 'char_offset_start', m[0].char_offset_start, "
        "'char_offset_end', m[size(m) - 1].char_offset_end))"
    ).format(b=begins)
    out = runs.select("chapter_id", "kind", "speaker", "attribution_source", F.explode(F.expr(joined)).alias("m"))
    return out.select(
        "chapter_id", F.row_number().over(per_chapter("m.id")).alias("id"), "kind", F.col("m.original_text").alias("original_text"),
        "speaker", "attribution_source", "m.paragraph_index", "m.char_offset_start", "m.char_offset_end",
    )


def split_segments(chapters: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Quote spans with narration merged."""
    return merge_narration(quote_segments(chapters), max_chars)


def _neighbour(offset: int) -> Column:
    """Text of the narration beside a segment, null if there is none."""
    kind, text = F.lag("kind", offset).over(per_chapter()), F.lag("original_text", offset).over(per_chapter())
    return F.when(kind == "narration", text)


def attribute_explicit(segments: DataFrame) -> DataFrame:
    """Speakers that narration beside unknown dialogue names, and the gender of pronouns where it names none."""
    context = F.nullif(F.concat_ws(" ", _neighbour(1), _neighbour(-1)), F.lit(""))
    rows = segments.withColumn("_context", F.when((F.col("kind") == "dialogue") & (F.col("speaker") == "unknown"), context))
    rows = rows.withColumn("_name", named_speaker(F.col("_context"))).withColumn("_gender", pronoun_gender(F.col("_context")))
    source = F.when(F.col("_name").isNotNull(), "explicit").when(F.col("_gender").isNotNull(), F.concat(F.lit("pronoun_"), "_gender"))
    return (
        rows.withColumn("speaker", F.coalesce("_name", "speaker"))
        .withColumn("attribution_source", F.coalesce(source, "attribution_source"))
        .drop("_context", "_name", "_gender")
    )


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(f" {w} "))
    return out


def resolve_pronouns(segments: DataFrame) -> DataFrame:
    """Give a line tagged by a pronoun to the only speaker of the chapter seen with that gender.

    A speaker's gender is the last one seen in narration beside their explicit lines; male words are
    looked for first."""
    seen = lambda offset: F.when(_has(F.lower(_neighbour(offset)), ("he", "his", "him")), "male").when(_has(F.lower(_neighbour(offset)), ("she", "her", "hers")), "female")
    named = (F.col("attribution_source") == "explicit") & (F.col("speaker") != "narrator")
    rows = segments.withColumn("_seen", F.when(named, F.coalesce(seen(-1), seen(1))))
    own = Window.partitionBy("chapter_id", "speaker")
    rows = rows.withColumn("_gender", F.when(named, F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("id"))).over(own)))
    whole = Window.partitionBy("chapter_id")
    only = F.lit(None).cast("string")
    for gender in ("male", "female"):
        who = F.when(F.col("_gender") == gender, F.col("speaker"))
        one = F.when(F.min(who).over(whole) == F.max(who).over(whole), F.min(who).over(whole))
        only = F.when(F.col("attribution_source") == f"pronoun_{gender}", one).otherwise(only)
    rows = rows.withColumn("_only", only)
    new = {"speaker": F.coalesce("_only", "speaker"), "attribution_source": F.when(F.col("_only").isNotNull(), "turn_taking").otherwise(F.col("attribution_source"))}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in segments.columns])


_TURN_STATE = "named_struct('p2', cast(null as string), 'p1', cast(null as string), 'streak', 0, 'given', cast(null as string))"
#: One step of the alternation: narration lengthens a streak and two in a row forget the speakers; a
#: known speaker who is not the last one moves up; an unknown line goes to the last but one, else the last.
_TURN_STEP = """case
  when x.line.kind = 'narration' then named_struct(
    'p2', if(s.streak >= 1, cast(null as string), s.p2), 'p1', if(s.streak >= 1, cast(null as string), s.p1), 'streak', s.streak + 1, 'given', cast(null as string))
  when x.line.kind <> 'dialogue' then named_struct('p2', s.p2, 'p1', s.p1, 'streak', 0, 'given', cast(null as string))
  when x.line.speaker <> 'unknown' and x.line.attribution_source <> 'none' then named_struct(
    'p2', if(s.p1 is null or s.p1 <> x.line.speaker, s.p1, s.p2), 'p1', x.line.speaker, 'streak', 0, 'given', cast(null as string))
  when s.p2 is not null then named_struct('p2', s.p1, 'p1', s.p2, 'streak', 0, 'given', s.p2)
  else named_struct('p2', s.p2, 'p1', s.p1, 'streak', 0, 'given', s.p1) end"""


def alternate_speakers(segments: DataFrame) -> DataFrame:
    """Unknown lines of a conversation alternate between its two latest speakers.

    The only state that later lines can see is the last two speakers and the length of the current run
    of narration, so a chapter is folded once over its lines and comes out of the fold as rows again.  The
    fold runs in blocks of about sqrt(n) lines, each with its own short list of speakers given, so that no
    list is copied for every line."""
    line = F.struct("id", F.struct(*[F.col(f"`{c}`") for c in segments.columns]).alias("line"))
    lines = segments.groupBy("chapter_id").agg(F.array_sort(F.collect_list(line), lambda a, b: a["id"] - b["id"]).alias("lines"))
    size = "cast(ceil(sqrt(size(lines))) as int)"
    inner = (
        f"aggregate(slice(lines, b * {size} + 1, {size}), named_struct('s', o.s, 'out', cast(array() as array<string>)), "
        f"(a, x) -> transform(array(a.s), s -> transform(array({_TURN_STEP}), t -> named_struct('s', t, 'out', concat(a.out, array(t.given))))[0])[0])"
    )
    given = (
        f"aggregate(sequence(0, (size(lines) - 1) div {size}), named_struct('s', {_TURN_STATE}, 'out', cast(array() as array<string>)), "
        f"(o, b) -> transform(array({inner}), t -> named_struct('s', t.s, 'out', concat(o.out, t.out)))[0], o -> o.out)"
    )
    turns = lines.select("chapter_id", F.explode(F.expr(f"zip_with(lines, {given}, (l, g) -> named_struct('line', l.line, 'given', g))")).alias("t"))
    new = {"chapter_id": F.col("chapter_id"), "speaker": F.coalesce("t.given", "t.line.speaker"), "attribution_source": F.when(F.col("t.given").isNotNull(), "turn_taking").otherwise(F.col("t.line.attribution_source"))}
    return turns.select(*[new.get(c, F.col(f"t.line.`{c}`")).alias(c) for c in segments.columns])


def resolve_sole_character(segments: DataFrame) -> DataFrame:
    """In a chapter with one named speaker, unknown lines are that speaker's."""
    named = F.when((F.col("kind") == "dialogue") & ~F.col("speaker").isin("unknown", "narrator"), F.col("speaker"))
    rows = segments.withColumn("_low", F.min(named).over(Window.partitionBy("chapter_id"))).withColumn("_high", F.max(named).over(Window.partitionBy("chapter_id")))
    fill = (F.col("kind") == "dialogue") & (F.col("speaker") == "unknown") & (F.col("_low") == F.col("_high"))
    rows = rows.withColumn("attribution_source", F.when(fill, "sole_character").otherwise(F.col("attribution_source")))
    return rows.withColumn("speaker", F.when(fill, F.col("_low")).otherwise(F.col("speaker"))).drop("_low", "_high")


def take_turns(segments: DataFrame) -> DataFrame:
    """Pronouns, then alternation, then the sole character."""
    return resolve_sole_character(alternate_speakers(resolve_pronouns(segments)))


def character_registry(segments: DataFrame) -> DataFrame:
    """The cast of each chapter in order of appearance, narrator first: chapter_id, position, name, gender,
    segments, male_votes, female_votes.  Narration beside a line votes for a gender, or both, by its pronouns."""
    votes = lambda p: sum((F.coalesce(_neighbour(o).rlike(rf"(?i)\b({p})\b"), F.lit(False)).cast("int") for o in (1, -1)), F.lit(0))
    rows = segments.select("chapter_id", "id", "kind", "speaker", votes("he|him|his").alias("m"), votes("she|her|hers").alias("f"))
    named = (F.col("kind") == "dialogue") & ~F.col("speaker").isin("unknown", "narrator")
    zero = F.lit(0)
    # Every row counts for the narrator of its chapter, who is there without a line as well, and named ones for their speaker.
    speaks = F.struct(F.col("speaker").alias("name"), F.lit(1).alias("n"), "m", "f", F.col("id").alias("seen"))
    tells = F.struct(F.lit("narrator").alias("name"), (F.col("speaker") == "narrator").cast("int").alias("n"), zero.alias("m"), zero.alias("f"), zero.alias("seen"))
    each = rows.select("chapter_id", F.explode(F.when(named, F.array(tells, speaks)).otherwise(F.array(tells))).alias("c"))
    cast = each.groupBy("chapter_id", F.col("c.name").alias("name")).agg(
        F.sum("c.n").alias("segments"), F.sum("c.m").alias("male_votes"), F.sum("c.f").alias("female_votes"), F.min("c.seen").alias("seen")
    )
    gender = F.when(F.col("seen") == 0, "neutral").when(F.col("male_votes") > F.col("female_votes"), "male").when(F.col("female_votes") > F.col("male_votes"), "female").otherwise("unknown")
    place = F.row_number().over(per_chapter("seen")) - 1
    return cast.select("chapter_id", place.alias("position"), "name", gender.alias("gender"), "segments", "male_votes", "female_votes")


def assign_pauses(segments: DataFrame) -> DataFrame:
    """Add ``pause_before_ms``."""
    gap = F.col("paragraph_index") - F.lag("paragraph_index").over(per_chapter())
    return segments.withColumn("pause_before_ms", pause_ms(F.col("kind"), F.lag("kind").over(per_chapter()), gap))


def normalise_segments(segments: DataFrame, lexicon: Column | None = None) -> DataFrame:
    """Add ``spoken_text``; a scene break that falls away lengthens ``pause_before_ms`` to a second."""
    pause = F.when(has_scene_break(F.col("original_text")), F.greatest("pause_before_ms", F.lit(1000))).otherwise(F.col("pause_before_ms"))
    return segments.withColumn("pause_before_ms", pause).withColumn("spoken_text", spoken_text(F.col("original_text"), lexicon))


def validate_completeness(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Whether a chapter's segments hold its words in order: chapter_id, passed, n_missing, n_extra,
    first_mismatch (word position, null if none), n_original, n_segments."""
    parts = segments.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("id", "original_text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["original_text"]), " ")
    both = chapters.join(parts, "chapter_id", "left").select("chapter_id", F.col("p").isNotNull().alias("some"), compared_form(F.col("text")).alias("a"), compared_form(joined).alias("b"))
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != "")
    both = both.withColumn("x", words("a")).withColumn("y", words("b"))
    shorter = F.least(F.size("x"), F.size("y"))
    differs = F.zip_with(F.slice("x", F.lit(1), shorter), F.slice("y", F.lit(1), shorter), lambda p, q: p != q)
    first = F.array_position(differs, True) - 1
    same = F.col("some") & (F.col("a") == F.col("b"))
    return both.select(
        "chapter_id", same.alias("passed"), F.size(F.array_except("x", "y")).alias("n_missing"), F.size(F.array_except("y", "x")).alias("n_extra"),
        F.when(first >= 0, first).alias("first_mismatch"), F.size("x").alias("n_original"), F.size("y").alias("n_segments"),
    )


def output_projection(segments: DataFrame) -> DataFrame:
    """What a chapter's analysis returns: narration is the narrator's, spoken text falls back to the original; no ``kind``."""
    return segments.select(
        "chapter_id", "id", F.when(F.col("kind") == "dialogue", F.col("speaker")).otherwise("narrator").alias("speaker"),
        F.coalesce(F.nullif("spoken_text", F.lit("")), "original_text").alias("text"), "pause_before_ms",
        F.when(F.col("kind") == "dialogue", F.col("emotion")).otherwise("neutral").alias("emotion"),
        F.round(F.when(F.col("kind") == "dialogue", F.col("intensity")).otherwise(0.5), 2).alias("intensity"),
    )


def analyser_lines(segments: DataFrame) -> DataFrame:
    """Segments as an outside analysis hands them on, ``kind`` among the fields: chapter_id, id, kind, speaker, original_text, spoken_text, pause_before_ms.
    Narration is the narrator's; texts and pauses that are missing are empty and 0."""
    original = F.coalesce("original_text", F.lit(""))
    return segments.select(
        "chapter_id", "id", "kind", F.when(F.col("kind") == "dialogue", F.col("speaker")).otherwise("narrator").alias("speaker"), original.alias("original_text"),
        F.coalesce(F.nullif("spoken_text", F.lit("")), original).alias("spoken_text"), F.coalesce("pause_before_ms", F.lit(0)).alias("pause_before_ms"),
    )


def context_windows(segments: DataFrame, around: int = 6, max_chars: int = 200) -> DataFrame:
    """For each unresolved line, the segments within ``around`` places of it in order, texts cut."""
    item = F.struct("id", "kind", "speaker", F.substring("original_text", 1, max_chars).alias("text"))
    rows = segments.withColumn("context", F.collect_list(item).over(per_chapter().rowsBetween(-around, around)))
    return rows.filter((F.col("kind") == "dialogue") & (F.col("speaker") == "unknown")).select("chapter_id", "id", "context")


def llm_batches(segments: DataFrame, size: int = 20) -> DataFrame:
    """Unresolved lines of a chapter in batches: chapter_id, batch, ids."""
    asked = segments.filter((F.col("kind") == "dialogue") & (F.col("speaker") == "unknown"))
    asked = asked.withColumn("batch", F.floor((F.row_number().over(per_chapter()) - 1) / size).cast("int"))
    return asked.groupBy("chapter_id", "batch").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def scene_candidates(segments: DataFrame, names: DataFrame, around: int = 12, size: int = 20) -> DataFrame:
    """For each batch of unresolved lines, who may be there: speakers of lines from ``around`` before the
    first to ``around`` after the last, and names (chapter_id, name) that their text mentions."""
    ids = F.col("ids")
    bounds = llm_batches(segments, size).select("chapter_id", "batch", (F.array_min(ids) - around).alias("low"), (F.array_max(ids) + around).alias("high"))
    near = segments.join(bounds, "chapter_id").filter(F.col("id").between(F.col("low"), F.col("high")))
    scene = near.groupBy("chapter_id", "batch").agg(
        F.collect_set(F.when(~F.col("speaker").isin("unknown", "narrator"), F.col("speaker"))).alias("speakers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "original_text"))), lambda x: x["original_text"]), " ").alias("blob"),
    )
    known = names.groupBy("chapter_id").agg(F.collect_set("name").alias("known"))
    scene = scene.join(known, "chapter_id", "left")
    told = F.filter(F.coalesce("known", F.array().cast("array<string>")), lambda n: F.call_function("rlike", F.col("blob"), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))))
    return scene.select("chapter_id", "batch", F.array_sort(F.array_union("speakers", told)).alias("candidates"))


def candidate_names(segments: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """Capitalised words inside narration sentences: the ``top`` most frequent of a chapter that occur ``least`` times."""
    text = segments.filter("kind = 'narration'").select("chapter_id", "id", F.posexplode(F.regexp_extract_all("original_text", F.lit(r"(?<=[a-z.,;!?’]\s)([A-Z][a-z]{2,})"), F.lit(1))).alias("pos", "name"))
    counted = text.filter(~F.col("name").isin(*COMMON_CAPITALS)).groupBy("chapter_id", "name").agg(F.count(F.lit(1)).alias("mentions"), F.min(F.struct("id", "pos")).alias("first"))
    rank = F.row_number().over(per_chapter(F.desc("mentions"), "first"))
    return counted.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("mentions") >= least)).select("chapter_id", "rank", "name", "mentions")
