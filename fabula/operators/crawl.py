"""The order of pages that link to their successors, by pointer jumping.

Each page knows its successor; in every round it learns its successor's successor and how far that is, so that a chain of n
pages is ranked in log2(n) rounds, each one join on the page.  Pages that still run after that many rounds are on a
ring or lead into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.sources.tables import kept


def reading_order(links: DataFrame) -> DataFrame:
    """The place of each page from ``links`` (page, next): page, last, left, place, on_ring.

    ``last`` is the page where the way ends, ``left`` how many pages come after this one, ``place`` its number from 1, counted from the
    farthest page that leads to the same last one (where chains meet, the longer one counts).  A next page that is null
    or not among the pages ends a way.  Pages on a ring have on_ring true, and like those that lead into one no last, left
    or place.  Of repeated pages the greatest next counts; a null page takes no part.
    """
    pages = kept(links.filter("page is not null").groupBy("page").agg(F.max("next").alias("next")), "links")
    kind = pages.schema["page"].dataType
    known = pages.select(F.col("page").alias("next"), F.lit(1).alias("known"))
    # ``to`` is the page that a way has come to; at its end that is ``last``, and there is no ``to``.
    first = pages.join(known, "next", "left").select(
        "page", F.when(F.col("known").isNotNull(), F.col("next")).alias("to"), F.when(F.col("known").isNull(), F.col("page")).cast(kind).alias("last"), F.coalesce("known", F.lit(0)).cast("long").alias("left")
    )
    now = kept(first, "ways")
    ended, ways = now.filter("to is null"), now.filter("to is not null")
    running, rounds = ways.count(), 0
    most = max(1, pages.count()).bit_length()
    while running and rounds < most:
        ahead = ended.unionByName(ways).select(F.col("page").alias("to"), F.col("to").alias("beyond"), "last", F.col("left").alias("more"))
        now = kept(ways.drop("last").join(ahead, "to").select("page", F.col("beyond").alias("to"), "last", (F.col("left") + F.col("more")).alias("left")), "ways")
        ended, ways = ended.unionByName(now.filter("to is null")), now.filter("to is not null")
        running, rounds = ways.count(), rounds + 1
    out = ended.drop("to")
    longest = out.groupBy("last").agg(F.max("left").alias("longest"))
    out = out.join(longest, "last").select("page", "last", "left", (F.col("longest") - F.col("left") + 1).alias("place"), F.lit(False).alias("on_ring"))
    if not running:
        return out
    # After as many rounds every pointer stands on a ring, and those of a ring's own pages on all of it.
    on_ring = kept(ways.select(F.col("to").alias("page")).distinct(), "ring")
    return out.unionByName(
        ways.select("page").join(on_ring.withColumn("on_ring", F.lit(True)), "page", "left").select(
            "page", F.lit(None).cast(kind).alias("last"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("place"), F.coalesce("on_ring", F.lit(False)).alias("on_ring")
        )
    )
