"""Numbered chapters out of EPUB files.

A book is opened once, by the task that holds its bytes, and becomes one row for each document of its
spine.  What a chapter covers (from its navigation point to the next one) is then a window and a join.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fabula.functions.spoken import word_count

# Elements that begin and end a line, and elements whose text is not read.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote br".split())
SKIPPED = frozenset("script style head".split())
LABEL = r"^\s*(\d+)\s*[.)-]\s*(.+?)\s*$"
PARTS = "book string, pos int, html string, points array<struct<place:int,label:string,anchor:string>>"


class _Lines(HTMLParser):
    def __init__(self, anchor: str | None):
        super().__init__(convert_charrefs=True)
        self.anchor, self.hidden, self.done, self.now = anchor, 0, [], ""

    def break_line(self, tag: str) -> None:
        if tag in BLOCKS and self.anchor is None:
            line = " ".join(self.now.replace("\t", " ").split(" ")).strip()
            while "  " in line:
                line = line.replace("  ", " ")
            self.done += [line] if line else []
            self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        else:
            if self.anchor is not None and ("id", self.anchor) in attrs:
                self.anchor = None
            self.break_line(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        else:
            self.break_line(tag)

    def handle_data(self, data):
        if self.anchor is None and not self.hidden:
            self.now += data


def html_lines(html: str, anchor: str | None = None) -> list[str]:
    """Text of the elements of a page, a line for each block; from the element ``anchor`` on, if one is given."""
    reader = _Lines(anchor or None)
    reader.feed(html)
    reader.close()
    reader.break_line("p")
    return reader.done


def _local(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == name]


def book_parts(path: str, content: BinaryIO, html: bool = True) -> Iterator[dict]:
    """The spine documents of one book, one at a time; without ``html`` only the package and the navigation are unpacked."""
    with zipfile.ZipFile(content) as book:
        names = book.namelist()
        package = _local(ElementTree.fromstring(book.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        opf = ElementTree.fromstring(book.read(package))
        at = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(href)))
        href = {i.get("id"): at(i.get("href")) for i in _local(opf, "item")}
        spine = [href[r.get("idref")] for r in _local(opf, "itemref") if r.get("idref") in href]
        nav = next((n for n in names if n.lower().endswith(".ncx")), None)
        if nav is None:
            raise FileNotFoundError(f"{path} has no NCX navigation document")
        points: dict[str, list[dict]] = {}
        for place, point in enumerate(_local(ElementTree.fromstring(book.read(nav)), "navPoint")):
            label, content_ = next(iter(_local(point, "text")), None), next(iter(_local(point, "content")), None)
            if label is not None and content_ is not None:
                target, _, anchor = (content_.get("src") or "").partition("#")
                points.setdefault(at(target), []).append({"place": place, "label": (label.text or "").strip(), "anchor": unquote(anchor)})
        for pos, name in enumerate(spine):
            first = spine.index(name) == pos
            yield {"book": path, "pos": pos, "html": book.read(name).decode("utf-8", "replace") if html and name in names else "", "points": points.get(name, []) if first else []}


def epub_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the EPUB files at ``path``."""
    return opened(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path))


def opened(files: DataFrame) -> DataFrame:
    """A row for each spine document of EPUB ``files`` (path, content): book, pos, html, points (navigation points into it)."""

    def run(batches):
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"], strict=True):
                for part in book_parts(book, io.BytesIO(content)):  # one document at a time, however long the book
                    yield pd.DataFrame([part])

    return files.select("path", "content").mapInPandas(run, PARTS)


@F.pandas_udf(ArrayType(StringType()))
def _read_lines(html: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([html_lines(h, a) for h, a in zip(html, anchor, strict=True)])


def _headed(lines: list[str], number: int, title: str) -> list[str]:
    """The title as the only heading: a numbered or equal line near the top becomes or stays it, bare numbers go, else it is put first."""
    lines, at = list(lines), 0
    while at < min(4, len(lines)):
        own = lines[at].strip()
        head, mark, rest = own.partition(own.lstrip("0123456789")[:1] or "\0") if own[:1].isdigit() else ("", "", "")
        if own == str(number):
            del lines[at]
            at = 0
            continue
        tail = own[len(head) :].lstrip() if head else ""
        if head.strip() == str(number) and tail[:1] in (".", ")", "-") and tail[1:].strip():
            return [*lines[:at], title, *lines[at + 1 :]]
        if own.lower() == title.strip().lower():
            return lines
        at += 1
    return [title, *lines]


@F.pandas_udf(ArrayType(StringType()))
def _with_heading(lines: pd.Series, number: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([_headed(list(own), n, t) for own, n, t in zip(lines, number, title, strict=True)])


def chapters(parts: DataFrame) -> DataFrame:
    """Numbered chapters: book, number, title, text, word_count.

    Every navigation point ends the one before it, but only those labelled ``1. Title`` are chapters; a
    chapter holds at least the document it starts in."""
    last = parts.groupBy("book").agg((F.max("pos") + 1).alias("n"))
    points = parts.select("book", "pos", F.explode("points").alias("p")).select("book", "pos", "p.*")
    until = F.lead("pos").over(Window.partitionBy("book").orderBy("place"))
    points = points.withColumn("until", until).join(last, "book").withColumn("until", F.greatest(F.coalesce("until", "n"), F.col("pos") + 1))
    points = points.filter(F.col("label").rlike(LABEL))
    points = points.select("book", "place", F.regexp_extract("label", LABEL, 1).cast("int").alias("number"), F.regexp_extract("label", LABEL, 2).alias("title"), "anchor", F.col("pos").alias("start"), "until")
    wanted = points.withColumn("pos", F.explode(F.expr("sequence(start, until - 1)")))
    read = wanted.join(parts.select("book", "pos", "html"), ["book", "pos"])
    read = read.withColumn("lines", _read_lines("html", F.when(F.col("pos") == F.col("start"), F.col("anchor")).otherwise("")))
    whole = read.groupBy("book", "place", "number", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "lines"))).alias("l"))
    whole = whole.withColumn("lines", _with_heading(F.flatten(F.transform("l", lambda x: x["lines"])), "number", "title"))
    text = F.trim(F.array_join("lines", "\n"))
    return whole.select("book", "number", "title", text.alias("text"), word_count(text).alias("word_count"))
