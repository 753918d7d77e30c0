"""A stored positional index: postings in files by token, searched phrase by phrase and renewed chapter by chapter.

A posting is a token of a segment with all its positions.  Postings lie in a folder for each generation and bucket of tokens,
sorted by token, so that a search opens the buckets of its words and, within them, the row groups that may hold them.
A renewed chapter is indexed alone, in a new generation; a table of chapters names the generation that counts for each,
and what older ones hold of it is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.operators.corpus import SEGMENT_KEY
from fabula.sources.tables import Folder

CHAPTER = ["book_id", "chapter_number"]
TOKEN = r"[\p{L}\p{N}]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class PhraseIndex:
    """An index in ``path`` with as many ``buckets`` as it was made with."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def generation(self) -> int:
        """The newest complete generation, 0 if there is none."""
        marks = [int(n.removeprefix("done-")) for n in Folder(self.spark, f"{self.path}/marks").names() if n.startswith("done-")]
        return max(marks, default=0)

    def renew(self, segments: DataFrame) -> int:
        """Index the chapters that ``segments`` (SEGMENT_KEY, text) hold, in place of what was known of them.  A chapter that lost all its
        segments is renewed by a row with a null text.  Searches see the new generation as a whole, once it is marked as done."""
        number = self.generation() + 1
        tokens = segments.select(*SEGMENT_KEY, F.posexplode(tokens_of(F.col("text"))).alias("pos", "token"))
        # Positions of a token within one segment: the array is as long as the segment at most.
        postings = tokens.groupBy("token", *SEGMENT_KEY).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        postings = postings.withColumn("bucket", self._bucket(F.col("token"))).repartitionByRange("bucket", "token", *SEGMENT_KEY).sortWithinPartitions("bucket", "token", *SEGMENT_KEY)
        postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={number}")
        segments.select(*CHAPTER).distinct().write.mode("overwrite").parquet(f"{self.path}/chapters/generation={number}")
        if not Folder(self.spark, f"{self.path}/marks").put(f"done-{number}", ""):
            raise RuntimeError(f"another load has made generation {number}")
        return number

    def postings(self, words: list[str]) -> DataFrame:
        """The postings that count of any of ``words``: token, SEGMENT_KEY, positions.  Buckets and tokens are filters of the scan."""
        now = self.generation()
        buckets = {r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(self._bucket(F.col("w"))).collect()}
        rows = self.spark.read.parquet(f"{self.path}/postings").filter((F.col("generation") <= now) & F.col("bucket").isin(*buckets) & F.col("token").isin(*words))
        chapters = self.spark.read.parquet(f"{self.path}/chapters").filter(F.col("generation") <= now)
        chapters = chapters.groupBy(*CHAPTER).agg(F.max("generation").alias("generation"))
        return rows.join(chapters, [*CHAPTER, "generation"], "left_semi").select("token", *SEGMENT_KEY, "positions")

    def search(self, phrase: str) -> DataFrame:
        """Segments that hold the words of ``phrase`` one after another: SEGMENT_KEY, hits (how many times).  Nothing is found for a phrase without words."""
        words = [r for r in self.spark.createDataFrame([(phrase,)], "p string").select(tokens_of(F.col("p"))).first()[0]]
        if not words or not self.generation():
            return self.spark.createDataFrame([], "book_id int, chapter_number long, chapter_seq int, hits long")
        distinct = sorted(set(words))
        place = F.array_position(F.array(*[F.lit(w) for w in distinct]), F.col("token"))
        found = self.postings(distinct).groupBy(*SEGMENT_KEY).agg(F.array_sort(F.collect_list(F.struct(place.alias("w"), "positions"))).alias("p"))
        found = found.filter(F.size("p") == len(distinct))
        at = F.get("p", F.lit(distinct.index(words[0])))["positions"]
        before = lambda by: lambda x: x - by
        for k, word in enumerate(words[1:], 1):
            at = F.array_intersect(at, F.transform(F.get("p", F.lit(distinct.index(word)))["positions"], before(k)))
        return found.select(*SEGMENT_KEY, F.size(at).cast("long").alias("hits")).filter("hits > 0")
