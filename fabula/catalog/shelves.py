"""Queries of books, stored chapters and votes, clip emotions, stage times and speakable texts.

A region is a book and its nations the numbered chapters; the EPUB files are made in memory, row by row."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.catalog import corpora as K
from fabula.catalog.library import feeling_client
from fabula.functions import media as M
from fabula.operators import corpus as C
from fabula.plans import models, stages
from fabula.sources import epub

CONTAINER = '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
PAGE = "<html><head><title>not read</title></head><body>{}</body></html>"


def _book(titles: list[str]) -> bytes:
    """An EPUB whose chapters have one document each, those of even number a second one, and an appendix without number."""
    pages, points = {}, []
    for n, title in enumerate(titles, 1):
        pages[f"c {n}.html"] = PAGE.format(f"<h1>{n}</h1><p>{title} one</p><script>no</script><div>two &amp;\tthree</div>")
        points.append((f"{n}. {title}", f"c%20{n}.html"))
        if n % 2 == 0:
            pages[f"c {n} more.html"] = PAGE.format("<p>more</p>")
    pages["end.html"] = PAGE.format("<p>appended</p>")
    points.append(("Appendix", "end.html"))
    items = "".join(f'<item id="i{k}" href="{name}"/>' for k, name in enumerate(pages))
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(pages))) + '<itemref idref="none"/>'
    nav = "".join(f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{src}"/></navPoint>' for label, src in points)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("META-INF/container.xml", CONTAINER)
        book.writestr("OPS/book.opf", f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>")
        book.writestr("OPS/toc.ncx", f"<ncx><navMap>{nav}</navMap></ncx>")
        for name, html in pages.items():
            book.writestr(f"OPS/{name}", html)
    return out.getvalue()


def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def bound(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: _book(list(t)))

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    files = n.select(F.format_string("b%d.epub", F.col("n_regionkey").cast("long")).alias("path"), bound(F.col("n.n_name")).alias("content"))
    return epub.chapters(epub.opened(files))


STORED = "p_size % 3 as book_id, p_partkey as number, {title} as title, p_size + {add} as word_count, p_size % 7 + {add} as segment_count, 0.5D + {add} as align_mean_score, 0.25D + {add} as align_coverage, p_partkey * 10D + {add} as audio_start_s"


def upsert_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three parts are stored chapters; every second one is loaded again, with another title and place."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = lambda title, add: [F.expr(e) for e in STORED.format(title=title, add=add).split(", ")]
    return C.upsert_chapters(part.filter("p_partkey % 3 <> 0").select(*rows("p_name", 0)), part.filter("p_partkey % 2 = 0").select(*rows("p_brand", 1)))


def upsert_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of even chapters are stored; those of every third chapter come anew, doubled."""
    v = K.votes(spark, sf_dir)
    new = v.filter("chapter_number % 3 = 0").withColumn("male_votes", F.col("male_votes") * 2)
    return C.upsert_votes(v.filter("chapter_number % 2 = 0"), new)


def clip_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clip_emotions(K.segments(spark, sf_dir).select("book_id", F.col("book_seq").alias("id"), "text"), feeling_client)


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return stages.time_by_kind(o.select(F.col("o_orderpriority").alias("name"), F.expr("if(o_orderkey % 3 = 0, 'model', 'plain')").alias("kind"), F.expr("cast(o_custkey % 1000 as bigint)").alias("ms")))


def speakable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text has a letter to speak, and the states of its alignment."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", M.is_speakable(F.col("t")).alias("speakable"), M.token_states(F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("states"))


QUERIES = {f.__name__: f for f in (epub_chapters, upsert_chapters, upsert_votes, clip_emotions, stage_times, speakable_texts)}

_STORED = STORED.replace("D + ", "::DOUBLE + ")

ORACLE_SQL = {
    "epub_chapters": """
WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, len(string_split(n_name, ' ')) AS w FROM nation)
SELECT 'b' || n_regionkey || '.epub' AS book, CAST(k AS INTEGER) AS number, n_name AS title, n_name || chr(10) || n_name || ' one' || chr(10) || 'two & three' || CASE WHEN k % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS text,
  CAST(2 * w + 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS word_count FROM n""",
    "upsert_chapters": f"""
WITH o AS (SELECT {_STORED.format(title='p_name', add=0)} FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT {_STORED.format(title='p_brand', add=1)} FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.book_id, o.book_id) AS book_id, coalesce(n.number, o.number) AS number, coalesce(n.title, o.title) AS title, coalesce(n.word_count, o.word_count) AS word_count, coalesce(n.segment_count, o.segment_count) AS segment_count,
  coalesce(n.align_mean_score, o.align_mean_score) AS align_mean_score, coalesce(n.align_coverage, o.align_coverage) AS align_coverage, coalesce(o.audio_start_s, n.audio_start_s) AS audio_start_s
FROM o FULL JOIN n ON o.book_id = n.book_id AND o.number = n.number""",
    "upsert_votes": K.PRELUDE + """
SELECT book_id, chapter_number, name, CASE WHEN chapter_number % 3 = 0 AND name <> 'narrator' THEN 2 * male_votes ELSE male_votes END AS male_votes, female_votes
FROM votes WHERE chapter_number % 2 = 0 OR (chapter_number % 3 = 0 AND name <> 'narrator')""",
    "clip_emotions": K.PRELUDE + f"""
, b AS (SELECT book_id, book_seq, (row_number() OVER (PARTITION BY book_id ORDER BY book_seq) - 1) // 25 AS batch FROM segments),
f AS (SELECT book_id, book_seq, min(book_seq) OVER (PARTITION BY book_id, batch) <> 2 AND book_seq % 11 < 9 AS ok FROM b)
SELECT book_id, book_seq AS id, CASE WHEN ok THEN {list(models.EMOTIONS)}[book_seq % 11 + 1] ELSE 'neutral' END AS emotion, CASE WHEN ok THEN least(1.0::DOUBLE, book_seq / 4.0::DOUBLE) ELSE 0.5::DOUBLE END AS intensity FROM f""",
    "stage_times": """
SELECT CAST(sum(ms) AS BIGINT) AS total_ms, CAST(coalesce(sum(ms) FILTER (NOT m), 0) AS BIGINT) AS plain_ms, CAST(coalesce(sum(ms) FILTER (m), 0) AS BIGINT) AS model_ms FROM (SELECT o_custkey % 1000 AS ms, o_orderkey % 3 = 0 AS m FROM orders)""",
    "speakable_texts": r"""
SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z]') AS speakable, CAST(2 * coalesce(list_sum([length(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')]), 0) + 1 AS INTEGER) AS states FROM documents""",
}
