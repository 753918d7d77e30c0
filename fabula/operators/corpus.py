"""The relational corpus: segments with times, characters, aliases, registry verdicts, full text.

Tables are immutable snapshots.  An upsert is a merge of the old table with new rows, keyed by natural
keys; a replaced chapter is an anti join and a union.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.spoken import word_count

NOT_CHARACTERS = ("narrator", "unknown")
SEGMENT_KEY = ["book_id", "chapter_number", "chapter_seq"]
CONFIDENCE = 0.6


def merged(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Upsert: rows of ``old`` with the columns ``update`` from the row of ``new`` with their key, and the new keys."""
    if old.isEmpty():
        return new.select(*old.columns)
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    both = o.alias("o").join(n.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in update:
            cols.append(F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_o"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*cols)


def upsert_books(old: DataFrame, new: DataFrame) -> DataFrame:
    """Books by slug; author, series and number stay as first stored."""
    return merged(old, new, ["slug"], ["title", "audio_source", "epub_source", "audio_duration_s"])


def upsert_chapters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chapters by (book_id, number); their place in the audio stays as first stored."""
    return merged(old, new, ["book_id", "number"], ["title", "word_count", "segment_count", "align_mean_score", "align_coverage"])


def upsert_votes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pronoun votes by (book_id, chapter_number, name), the narrator's left out; names that a chapter lost stay."""
    return merged(old, new.filter("name <> 'narrator'"), ["book_id", "chapter_number", "name"], ["male_votes", "female_votes"])


def load_segments(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments with order keys, word counts and the times of their aligned spans.

    ``segments``: book_id, chapter_number, id, kind, speaker, text.  ``spans``: book_id, chapter_number,
    id, start, end, mean_score, words, offset.  A chapter leaves room for 100000 segments in book_seq."""
    order = Window.partitionBy("book_id", "chapter_number").orderBy("id")
    rows = segments.withColumn("chapter_seq", F.row_number().over(order)).join(spans, ["book_id", "chapter_number", "id"], "left")
    return rows.select(
        *SEGMENT_KEY, (F.col("chapter_number").cast("long") * 100000 + F.col("chapter_seq")).alias("book_seq"), "kind", "speaker", "text",
        word_count(F.col("text")).alias("word_count"), F.round(F.col("offset") + F.col("start"), 3).alias("audio_start_s"),
        F.round(F.col("offset") + F.col("end"), 3).alias("audio_end_s"), F.round(F.col("end") - F.col("start"), 3).alias("duration_s"),
        F.col("mean_score").alias("align_score"), F.col("words").alias("align_words"),
    )


def replaced(old: DataFrame, new: DataFrame, scope: tuple[str, ...] = ("book_id", "chapter_number")) -> DataFrame:
    """``old`` without the chapters that ``new`` holds, and ``new``."""
    return old.join(new.select(*scope).distinct(), list(scope), "left_anti").unionByName(new)


def carried_annotations(meta: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations (key, value by SEGMENT_KEY) of ``old`` segments that stand with the same text in ``new``."""
    texts = meta.join(old.select(*SEGMENT_KEY, "text"), SEGMENT_KEY)
    return texts.join(new.select(*SEGMENT_KEY, "text"), [*SEGMENT_KEY, "text"], "left_semi").drop("text")


def align_spans(words: DataFrame) -> DataFrame:
    """Spans of segments from their words (book_id, chapter_number, segment_id, idx, start, end, score)."""
    out = words.groupBy("book_id", "chapter_number", "segment_id").agg(
        F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.count(F.lit(1)).alias("words"), F.round(F.avg("score"), 3).alias("mean_score")
    )
    return out.withColumn("duration", F.round(F.col("end") - F.col("start"), 3))


def align_health(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Health of each chapter's alignment; ``durations``: book_id, chapter_number, audio_s."""
    key = ["book_id", "chapter_number"]
    spans = align_spans(words).groupBy(*key).agg(F.min("start").alias("first"), F.max_by("end", "start").alias("last"), F.sum("duration").alias("speech"))
    scores = words.groupBy(*key).agg(F.count(F.lit(1)).alias("word_count"), F.avg("score").alias("mean"), F.count_if(F.col("score") < 0.5).alias("low_confidence_words"))
    d = F.col("audio_s")
    return scores.join(spans, key).join(durations, key).select(
        *key, "word_count", F.round("mean", 4).alias("mean_score"), "low_confidence_words", F.round((F.col("last") - F.col("first")) / d, 4).alias("coverage"),
        F.round(F.col("speech") / d, 4).alias("speech_ratio"), F.round("first", 2).alias("leading_silence_s"), F.round(d - F.col("last"), 2).alias("trailing_silence_s"),
    )


def rebuild_characters(segments: DataFrame, votes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Characters of each book with their lines, votes and gender; a confident registry verdict wins over votes."""
    lines = segments.filter((F.col("kind") != "heading") & ~F.col("speaker").isin(*NOT_CHARACTERS))
    lines = lines.groupBy("book_id", F.col("speaker").alias("name")).agg(F.count(F.lit(1)).alias("segment_count"))
    tally = votes.groupBy("book_id", "name").agg(F.sum("male_votes").alias("male_votes"), F.sum("female_votes").alias("female_votes"))
    rows = lines.join(tally, ["book_id", "name"], "left").fillna(0, ["male_votes", "female_votes"])
    m, f = F.col("male_votes"), F.col("female_votes")
    rows = rows.withColumn("gender", F.when(m > f, "male").when(f > m, "female").otherwise("unknown"))
    return rows if registry is None else override_gender(rows, registry)


def override_gender(characters: DataFrame, registry: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    sure = registry.filter(F.col("gender").isin("male", "female") & (F.col("confidence") >= confidence)).select("book_id", "name", F.col("gender").alias("_g"))
    out = characters.join(sure, ["book_id", "name"], "left")
    return out.withColumn("gender", F.coalesce("_g", "gender")).select(*characters.columns)


def overrides(characters: DataFrame, registry: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """How many characters of each book have a gender that the registry is sure of: book_id, gender_set."""
    sure = registry.filter(F.col("gender").isin("male", "female") & (F.col("confidence") >= confidence)).select("book_id", "name")
    return characters.select("book_id", "name").join(sure, ["book_id", "name"]).groupBy("book_id").agg(F.count(F.lit(1)).alias("gender_set"))


def aligned_view(segments: DataFrame, name: str = "voice_corpus") -> None:
    """A view of what clips are picked from: the segments with a place in the audio, to be ordered by book_id and book_seq."""
    raw = F.col("speaker_raw") if "speaker_raw" in segments.columns else F.lit(None).cast("string")
    columns = ["book_id", "speaker", raw.alias("speaker_raw"), "kind", "chapter_number", "book_seq", "text", "word_count", "audio_start_s", "audio_end_s", "duration_s", "align_score"]
    segments.filter("audio_start_s is not null").select(*columns).createOrReplaceTempView(name)


def cast_of(segments: DataFrame) -> DataFrame:
    """The speakers of each book, a row for each: book_id, speaker, by_name and by_entrance (places from 1 in order of name and of their first line)."""
    first = segments.groupBy("book_id", "speaker").agg(F.min("book_seq").alias("first"))
    place = lambda *order: F.row_number().over(Window.partitionBy("book_id").orderBy(*order))
    return first.select("book_id", "speaker", place("speaker").alias("by_name"), place("first", "speaker").alias("by_entrance"))


def label_counts(segments: DataFrame) -> DataFrame:
    """Lines of each label as attribution gave it."""
    raw = F.coalesce("speaker_raw", "speaker") if "speaker_raw" in segments.columns else F.col("speaker")
    rows = segments.filter("kind <> 'heading'").select("book_id", raw.alias("label")).filter(~F.col("label").isin(*NOT_CHARACTERS))
    return rows.groupBy("book_id", "label").agg(F.count(F.lit(1)).alias("lines"))


def label_stats(segments: DataFrame, min_lines: int = 2) -> DataFrame:
    rows = segments.filter((F.col("kind") == "dialogue") & ~F.col("speaker").isin(*NOT_CHARACTERS))
    out = rows.groupBy("book_id", F.col("speaker").alias("name")).agg(F.count(F.lit(1)).alias("lines"), F.min("chapter_number").alias("first_ch"), F.max("chapter_number").alias("last_ch"))
    return out.filter(F.col("lines") >= min_lines)


def name_pairs(prose: DataFrame, min_pairs: int = 3) -> DataFrame:
    """How often the prose (book_id, text) has two capitalised words in a row: book_id, first, surname, pairs, from ``min_pairs`` times."""
    pairs = prose.select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), F.lit(0))).alias("p"))
    pairs = pairs.groupBy("book_id", "p").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") >= min_pairs)
    return pairs.select("book_id", F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("surname"), "pairs")


def surname_owners(prose: DataFrame, labels: DataFrame, min_lines: int = 5, min_pairs: int = 3) -> DataFrame:
    """Which first names the prose (book_id, text) gives a surname: book_id, surname, first, pairs, ambiguous.

    First names are labels of one word with ``min_lines`` lines; a pair counts from ``min_pairs`` times."""
    anchors = labels.filter((~F.contains("label", F.lit(" "))) & (F.col("lines") >= min_lines)).select("book_id", F.col("label").alias("first"))
    owners = name_pairs(prose, min_pairs).join(anchors, ["book_id", "first"], "left_semi")
    return owners.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("book_id", "surname")) > 1)


def _proposed(lines: dict[str, int], owners: dict[str, dict[str, int]], min_lines: int) -> dict[str, tuple[str, str, int]]:
    """What each label of a book stands for by the first rule that fits: canonical, reason, evidence."""
    out = {}
    for label in lines:
        words = label.split(" ")
        own = owners.get(label, {})
        tail = next((t for t in (" ".join(words[k:]) for k in range(1, len(words))) if t in lines and len(owners.get(t, ())) < 2), None)
        if len(own) == 1 and label not in own:
            ((first, pairs),) = own.items()
            out[label] = (first, "surname", pairs)
        elif tail is not None:
            out[label] = (tail, "suffix", lines[tail])
        elif len(words) == 2 and lines.get(words[0], 0) >= min_lines:
            out[label] = (words[0], "full_name", lines[words[0]])
    return out


def _ends(step: dict[str, str]) -> dict[str, str]:
    """Where the chain from each name stops: at a name without a step, or at the first met twice.  Every name is walked once."""
    end: dict[str, str] = {}
    for start in step:
        way, at = {}, start
        while at in step and at not in way and at not in end:
            way[at] = len(way)
            at = step[at]
        # Names on a ring meet themselves again; those before it stop at the name where they enter it.
        enter = way.get(at, len(way))
        last = end.get(at, at)
        for name, k in way.items():
            end[name] = last if k < enter else name
    return end


def derive_aliases(labels: DataFrame, pairs: DataFrame, min_lines: int = 5) -> DataFrame:
    """Labels that stand for another: book_id, alias, canonical, reason, evidence, lines.

    ``labels``: book_id, label, lines.  ``pairs``: book_id, first, surname, pairs, from the prose (``name_pairs`` or ``surname_owners``).
    Rules by rank: a surname of one owner, which is a label of one word with ``min_lines`` lines; a label that ends in another label
    (longest ending first), unless several own that ending; a known first name with one more word.  Chains are followed to their end;
    a label that leads back to itself is left alone.

    Both tables are counted already, so a book's part is its cast and its frequent names, however long the book is: it is
    looked up and followed in one group by book, and each table is read once.
    """

    def derived(key, tables):
        own = tables[tables["kind"] == "label"]
        lines = dict(zip(own["name"], own["n"].astype(int), strict=True))
        told = tables[tables["kind"] == "pair"]
        owners: dict[str, dict[str, int]] = {}
        for first, surname, n in zip(told["name"], told["surname"], told["n"], strict=True):
            if " " not in first and lines.get(first, 0) >= min_lines:
                owners.setdefault(surname, {})[first] = int(n)
        found = _proposed(lines, owners, min_lines)
        end = _ends({label: canonical for label, (canonical, _, _) in found.items()})
        rows = [(key[0], label, end[label], reason, evidence, lines[label]) for label, (_, reason, evidence) in found.items() if end[label] != label]
        return pd.DataFrame(rows, columns=["book_id", "alias", "canonical", "reason", "evidence", "lines"])

    book = labels.schema["book_id"].dataType.simpleString()
    each = labels.select("book_id", F.lit("label").alias("kind"), F.col("label").alias("name"), F.lit(None).cast("string").alias("surname"), F.col("lines").alias("n"))
    each = each.unionByName(pairs.select(F.col("book_id").cast(book).alias("book_id"), F.lit("pair").alias("kind"), F.col("first").alias("name"), "surname", F.col("pairs").alias("n")))
    return each.filter("name is not null").groupBy("book_id").applyInPandas(derived, f"book_id {book}, alias string, canonical string, reason string, evidence long, lines long")


def apply_aliases(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Speakers as their aliases say; ``speaker_raw`` keeps what attribution gave, where it is changed."""
    raw = F.coalesce("speaker_raw", "speaker") if "speaker_raw" in segments.columns else F.col("speaker")
    rows = segments.withColumn("_raw", raw)
    a = aliases.select("book_id", F.col("alias").alias("_raw"), F.col("canonical").alias("_to"))
    rows = rows.join(a, ["book_id", "_raw"], "left")
    kept = F.col("speaker_raw") if "speaker_raw" in segments.columns else F.lit(None).cast("string")
    rows = rows.withColumn("speaker_raw", F.when(F.col("_to").isNotNull(), F.col("_raw")).otherwise(kept))
    return rows.withColumn("speaker", F.coalesce("_to", "speaker")).drop("_raw", "_to")


def guard_verdicts(verdicts: DataFrame, labels: DataFrame, owners: DataFrame) -> DataFrame:
    """Merges (book_id, name, canonical) with a verdict: only those that labels or prose support are merged."""
    sure = owners.filter("not ambiguous").select("book_id", F.col("surname").alias("name"), F.col("first").alias("_owner"))
    shared = owners.filter("ambiguous").groupBy("book_id").agg(F.collect_set("surname").alias("_shared"))
    known = labels.select("book_id", F.col("label").alias("canonical"), F.lit(True).alias("_known"))
    rows = verdicts.join(known, ["book_id", "canonical"], "left").join(sure, ["book_id", "name"], "left").join(shared, "book_id", "left")
    words, none = F.split("name", " "), F.array().cast("array<string>")
    shared = F.coalesce("_shared", none)
    many, bad = F.size(words) > 1, lambda c: F.array_contains(shared, c)
    verdict = (
        F.when(F.col("canonical").isNull(), "proposed")
        .when(F.col("canonical") == F.col("name"), "vetoed:self")
        .when(F.col("_known").isNull(), "vetoed:unknown-target")
        .when(many & F.array_contains(words, F.col("canonical")) & ~bad(F.col("canonical")), "merge")
        .when(bad(F.col("name")) | (many & bad(F.element_at(words, -1))), "vetoed:shared-surname")
        .when(F.col("_owner") == F.col("canonical"), "merge")
        .otherwise("vetoed:unsupported")
    )
    return rows.select("book_id", "name", F.when(verdict != "vetoed:self", F.col("canonical")).alias("canonical"), verdict.alias("verdict"))


def store_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert verdicts by (book_id, name); a target is kept only where the verdict is a merge."""
    new = new.withColumn("canonical", F.when(F.col("verdict") == "merge", F.col("canonical")))
    return merged(old, new, ["book_id", "name"], [c for c in old.columns if c not in ("book_id", "name")])


def verdict_aliases(registry: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Aliases of confident merges: book_id, alias, canonical, reason, evidence."""
    sure = registry.filter((F.col("verdict") == "merge") & (F.col("confidence") >= confidence) & F.col("canonical").isNotNull())
    return sure.select("book_id", F.col("name").alias("alias"), "canonical", F.lit("llm").alias("reason"), F.lit(0).cast("long").alias("evidence"))


def store_aliases(old: DataFrame, new: DataFrame, evidence: bool = True) -> DataFrame:
    """Upsert aliases by (book_id, alias); ``evidence`` false keeps the count that is stored."""
    return merged(old, new, ["book_id", "alias"], ["canonical", "reason", *(["evidence"] if evidence else [])])


def text_index(segments: DataFrame) -> DataFrame:
    """Tokens of segments by position: SEGMENT_KEY, pos, token."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return segments.select(*SEGMENT_KEY, F.posexplode(tokens).alias("pos", "token"))


def phrase_hits(index: DataFrame, phrase: list[str]) -> DataFrame:
    """Segments whose tokens hold ``phrase`` in a row: a join of the postings of its words, shifted to its start."""
    hits = None
    for k, word in enumerate(phrase):
        here = index.filter(F.col("token") == word.lower()).select(*SEGMENT_KEY, (F.col("pos") - k).alias("at")).distinct()
        hits = here if hits is None else hits.join(here, [*SEGMENT_KEY, "at"])
    return hits.groupBy(*SEGMENT_KEY).agg(F.count(F.lit(1)).alias("hits"))


def evidence(segments: DataFrame, votes: DataFrame, min_lines: int = 2, n_narration: int = 6, n_dialogue: int = 4, chars: int = 260) -> DataFrame:
    """What is known of each label: lines, chapters, votes, narration that names it, lines it speaks.

    Narration is tokenised once and joined to labels of one word by token; longer labels by containment
    of the whole phrase after the join on their first word."""
    stats = label_stats(segments, min_lines)
    tally = votes.groupBy("book_id", "name").agg(F.sum("male_votes").alias("male_votes"), F.sum("female_votes").alias("female_votes"))
    told = segments.filter("kind = 'narration'")
    index = text_index(told).select("book_id", "chapter_number", "chapter_seq", "token").distinct()
    first = stats.select("book_id", "name", F.lower(F.substring_index("name", " ", 1)).alias("token"))
    hits = first.join(index, ["book_id", "token"]).join(told.select(*SEGMENT_KEY, "book_seq", "text"), SEGMENT_KEY)
    hits = hits.filter(F.call_function("rlike", "text", F.concat(F.lit(r"(?i)\b\Q"), "name", F.lit(r"\E\b"))))
    place = Window.partitionBy("book_id", "name").orderBy("book_seq")
    first_of = lambda df, n, out: df.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n).groupBy("book_id", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"]).alias(out)
    )
    said = segments.filter("kind = 'dialogue' and word_count between 4 and 40").withColumn("name", F.col("speaker"))
    out = stats.join(tally, ["book_id", "name"], "left").join(first_of(hits, n_narration, "narration"), ["book_id", "name"], "left")
    out = out.join(first_of(said, n_dialogue, "dialogue"), ["book_id", "name"], "left")
    return out.fillna(0, ["male_votes", "female_votes"])


def corpus_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("book_id").agg(
        F.count_distinct("chapter_number").alias("chapters"), F.count(F.lit(1)).alias("segments"), F.count_if(F.col("audio_start_s").isNotNull()).alias("aligned"),
        F.round(F.sum("duration_s"), 3).alias("seconds"), F.round(F.avg("align_score"), 4).alias("mean_score"),
    )


def top_speakers(segments: DataFrame, n: int = 15) -> DataFrame:
    rows = segments.groupBy("book_id", "speaker").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 60, 2).alias("minutes"), F.round(F.avg("align_score"), 3).alias("score")
    )
    order = Window.partitionBy("book_id").orderBy(F.desc("lines"), "speaker")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def marker_differences(markers: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters (number, title) that only audio markers or only the text have, and titles that differ."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    m, c = markers.select("number", F.col("title").alias("marker_title")), chapters.select("number", F.col("title").alias("text_title"))
    both = m.join(c, "number", "full")
    state = F.when(F.col("text_title").isNull(), "missing text").when(F.col("marker_title").isNull(), "extra text").when(plain(F.col("marker_title")) != plain(F.col("text_title")), "title differs")
    return both.withColumn("state", state).filter("state is not null")


def chosen_chapters(chapters: DataFrame, spec: str, column: str = "number") -> DataFrame:
    """Chapters that a list such as ``1``, ``3-10`` or ``1,4,7-9`` names."""
    keep: Column = F.lit(False)
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        keep = keep | F.col(column).between(int(low), int(high or low))
    return chapters.filter(keep)
