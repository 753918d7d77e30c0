"""Columns that read dialogue, names and pronouns out of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that introduce speech.
SPEECH_VERBS = tuple(
    "said asked replied answered whispered shouted yelled screamed called cried exclaimed demanded declared announced stated responded muttered murmured growled "
    "hissed snapped barked snarled roared bellowed shrieked gasped sighed groaned moaned pleaded begged insisted suggested warned urged protested objected agreed "
    "admitted confessed explained continued added interrupted interjected repeated stammered stuttered blurted rasped croaked wheezed panted breathed mouthed "
    "chanted sang recited quoted remarked noted observed commented mentioned offered proposed countered conceded acknowledged confirmed denied lied vowed swore "
    "promised threatened taunted mocked teased joked laughed chuckled giggled sobbed wept wailed sniffled wondered pondered mused reflected".split()
)
# Words that are no names, whatever their case.
NON_NAMES = tuple(
    "he she it we you i me my mine your yours us hers theirs myself himself herself itself themselves ourselves yourself neither either if as at by in on to of or "
    "is am be no yes so up down off back away instead perhaps maybe suddenly finally meanwhile although though unless until since once whenever everyone someone "
    "nobody anyone something nothing anything everything eventually apparently obviously fortunately unfortunately thankfully honestly clearly actually besides "
    "however therefore moreover otherwise whether despite during without within toward towards across behind beside beyond against among around the this that these "
    "those there then than they them their what when where which while who whom whose with will would could should have has had been being does did done from into "
    "onto upon after before above below about again also another because between both but each even every for here how just like more most much never not now only "
    "other over some still such through under very well were why and are can her him his its may nor our out own per too two was yet all any few got get let new old "
    "one say see set way".split()
)
# Capitalised words that are common inside sentences.
COMMON_CAPITALS = tuple(
    "The There Their They These This That Those Then Than When Where What Which While Who How Here His Her Its Our But And For Not All Can Has Had Was Were Are Did "
    "Does May Most Much Many Some Just Also From Into With After Before About Still Even Only Very Each Every Both Such Instead Mostly".split()
)

OPEN, CLOSE = "", ""  # stand for straight quotes that open and close

# What a speech verb, a name of one to three capitalised words, and their orders look like.
_VERB = "(?i:" + "|".join(sorted(SPEECH_VERBS, key=lambda v: (-len(v), v))) + ")"
_NAME = r"((?:[Tt]he\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
VERB_NAME = rf"\b{_VERB}\s+{_NAME}"
NAME_VERB = rf"{_NAME}\s+{_VERB}\b"
PRONOUN_VERB = rf"\b(?i:(he|she))\s+{_VERB}\b"
VERB_PRONOUN = rf"\b{_VERB}\s+(?i:(he|she))\b"


def quote_spans(paragraph: Column) -> Column:
    """Array of the spans of a paragraph, which together are the whole of it: dialogue and what stands between.

    A straight quote closes after a letter, digit or sentence mark, else it opens; each is first
    replaced by a sign of its own, so that one pattern cuts the paragraph.  Signs are one character
    long, so positions are running sums of span lengths."""
    marked = F.regexp_replace(paragraph, "([A-Za-z0-9.,!?;…’'])\"", "$1" + CLOSE)
    pattern = f"[“«{OPEN}][^”»{CLOSE}]*[”»{CLOSE}]?|[^“«{OPEN}]+"
    return F.regexp_extract_all(F.translate(marked, '"', OPEN), F.lit(pattern), F.lit(0))


def is_spoken(span: Column) -> Column:
    return F.substring(span, 1, 1).isin("“", "«", OPEN)


def span_text(span: Column) -> Column:
    """A span without the quotes around it, inner straight quotes as they were."""
    bare = F.regexp_replace(F.regexp_replace(span, f"^[“«{OPEN}]", ""), f"[”»{CLOSE}]$", "")
    return F.trim(F.translate(F.when(is_spoken(span), bare).otherwise(span), OPEN + CLOSE, '""'))


def _first_name(context: Column, pattern: str) -> Column:
    names = F.transform(F.regexp_extract_all(context, F.lit(pattern), F.lit(1)), lambda n: F.trim(F.regexp_replace(F.trim(n), r"^(?i:the)\s+", "")))
    words = lambda n: F.split(F.lower(n), r"\s+")
    good = F.filter(names, lambda n: (F.length(n) >= 2) & ~F.arrays_overlap(words(n), F.expr(f"array{NON_NAMES}")))
    return F.get(good, F.lit(0))


def named_speaker(context: Column) -> Column:
    """The first name that a speech verb gives in ``context``: verb before name, else name before verb; null if none."""
    return F.coalesce(_first_name(context, VERB_NAME), _first_name(context, NAME_VERB))


def pronoun_gender(context: Column) -> Column:
    """``male`` or ``female`` by the pronoun beside a speech verb, null if none."""
    found = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(context, p, 1)), F.lit("")) for p in (PRONOUN_VERB, VERB_PRONOUN)])
    return F.when(found == "he", F.lit("male")).when(found == "she", F.lit("female"))


def pause_ms(kind: Column, previous_kind: Column, gap: Column) -> Column:
    """Silence before a segment, from its kind, that of the one before (null: none) and the paragraphs between."""
    both = lambda a, b: (previous_kind == a) & (kind == b)
    return (
        F.when(previous_kind.isNull(), 0)
        .when((gap > 1) & ~both("narration", "narration"), 1000)
        .when(gap >= 1, 500)
        .when(both("narration", "dialogue"), 350)
        .when(both("dialogue", "narration"), 300)
        .when(both("dialogue", "dialogue"), 250)
        .otherwise(500)
    )
