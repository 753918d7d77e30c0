"""Chapter text from web pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The element that holds a chapter, by name and attribute.
CONTENT = ("div", 'class="chapter-inner chapter-content"')


@F.pandas_udf(ArrayType(StringType()))
def _decoded(parts: pd.Series) -> pd.Series:
    """All character references of HTML, named and numeric."""
    return parts.map(lambda ps: [html.unescape(p) for p in ps], na_action="ignore")


def _references(parts: Column) -> Column:
    """``parts`` decoded; those without a reference, which are most, do not travel."""
    return F.coalesce(_decoded(F.when(F.contains(F.array_join(parts, ""), F.lit("&")), parts)), parts)


def element(source: Column, name: str, attribute: str = "") -> Column:
    """Bodies of the elements ``name``, an array; each ends at the first closing tag."""
    opening = rf"<{name}\b[^>]*" + (rf"\Q{attribute}\E[^>]*" if attribute else "") + ">"
    return F.regexp_extract_all(source, F.lit(rf"(?s){opening}(.*?)</{name}>"), F.lit(1))


def plain_lines(bodies: Column) -> Column:
    """Bodies of elements as text: tags gone, references decoded, blanks collapsed, empty ones dropped."""
    bare = _references(F.transform(bodies, lambda b: F.regexp_replace(b, "<[^>]+>", "")))
    tidy = F.transform(bare, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), "[ \t\u00a0]+", " "))
    return F.filter(tidy, lambda t: t != "")


def page_text(pages: DataFrame, content: tuple[str, str] = CONTENT) -> DataFrame:
    """page_id, title (before `` - ``), text (the paragraphs of the page's content element by line), next_href.

    ``pages``: page_id, html.  A page without the element, and a null one, has no text."""
    body = F.get(element(F.col("html"), *content), F.lit(0))
    titles = _references(F.filter(element(F.col("html"), "title"), lambda t: ~F.contains(t, F.lit("<"))))
    link = F.regexp_extract("html", r'(?is)<a\b[^>]*\bhref="([^"]+)"[^>]*>\s*next\s*(?:chapter)?\s*<', 1)
    return pages.select(
        "page_id", F.coalesce(F.substring_index(F.get(titles, F.lit(0)), " - ", 1), F.lit("")).alias("title"),
        F.coalesce(F.array_join(plain_lines(element(body, "p")), "\n"), F.lit("")).alias("text"), F.nullif(link, F.lit("")).alias("next_href"),
    )
