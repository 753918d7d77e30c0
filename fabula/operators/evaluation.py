"""Attribution against a gold set, and speech against its text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.spoken import heard_words, word_key


def similarity(rows: DataFrame, expected: str = "expected", heard: str = "heard") -> DataFrame:
    """Add ``similarity``: the better of the word and the character ratio of matching blocks, after both texts
    are normalised; 1 if both are empty, 0 if one is."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x, y):
            x, y = list(x), list(y)
            if not x or not y:
                return float(not x and not y)
            return max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, "".join(x), "".join(y)).ratio())

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    words = lambda c: heard_words(F.coalesce(F.col(c), F.lit("")))
    return rows.withColumn("similarity", ratio(words(expected), words(heard)))


def gold_set(lines: DataFrame, min_words: int = 4) -> DataFrame:
    """(key, speaker) of lines (text, speaker) of ``min_words`` words or more that only one speaker says."""
    keyed = lines.select(word_key(F.col("text")).alias("key"), "speaker").filter(F.size(F.split("key", " ")) >= min_words).filter("key <> ''")
    one = keyed.groupBy("key").agg(F.min("speaker").alias("speaker"), F.max("speaker").alias("_x"))
    return one.filter("speaker = _x").drop("_x")


def matched_quotes(quotes: DataFrame, gold: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Quotes (quote, label) that the gold set has, with an outcome: correct if one name contains the other."""
    rows = quotes.select(word_key(F.col("quote")).alias("key"), F.regexp_replace("label", r"^[\[\]]+|[\[\]]+$", "").alias("got")).join(gold, "key")
    if aliases is not None:
        a = aliases.select(F.lower("alias").alias("_low"), F.col("canonical").alias("_to"))
        rows = rows.withColumn("_low", F.lower("got")).join(a, "_low", "left").withColumn("got", F.coalesce("_to", "got")).drop("_low", "_to")
    g, w = F.lower("got"), F.lower("speaker")
    none = F.col("got").isNull() | (F.col("got") == "")
    hit = F.contains(g, w) | F.contains(w, g)
    return rows.select("key", F.col("speaker").alias("want"), "got", F.when(none, "unlabelled").when(hit, "correct").otherwise("wrong").alias("outcome"))


def accuracy(matched: DataFrame) -> DataFrame:
    of = lambda o: F.count_if(F.col("outcome") == o)
    out = matched.agg(F.count(F.lit(1)).alias("matched"), of("correct").alias("correct"), of("unlabelled").alias("unlabelled"), of("wrong").alias("wrong"))
    return out.withColumn("percent", F.round(100 * F.col("correct") / F.greatest("matched", F.lit(1)), 1))


def confusions(matched: DataFrame, top: int = 12) -> DataFrame:
    counted = matched.filter("outcome = 'wrong'").groupBy("want", "got").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "want", "got").limit(top)


def cluster_labels(mentions: DataFrame) -> DataFrame:
    """A name for each cluster from mentions (cluster, pos, kind, text): its most frequent proper name, else
    its most frequent noun in brackets; of equals the one seen first."""
    counted = mentions.filter(F.col("kind").isin("PROP", "NOM")).groupBy("cluster", "kind", "text").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.col("kind") == "PROP"), F.desc("n"), "first")
    best = counted.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("cluster", F.when(F.col("kind") == "PROP", F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("label"), "n")


def speakers_by_quote(segments: DataFrame, quotes: DataFrame, prefix_words: int = 6) -> DataFrame:
    """Speakers for segments (id, text) from quotes (pos, quote, speaker): by the same words, the last such
    quote, else by the first six words, the first such quote."""
    keyed = quotes.select("pos", "speaker", word_key(F.col("quote")).alias("key")).filter("key <> ''")
    head = lambda c: F.when(F.size(F.split(c, " ")) >= prefix_words, F.substring_index(c, " ", prefix_words))
    exact = keyed.groupBy("key").agg(F.max_by("speaker", "pos").alias("_exact"), F.min("pos").alias("_pos"))
    start = exact.withColumn("head", head("key")).filter("head is not null").groupBy("head").agg(F.min_by("_exact", "_pos").alias("_prefix"))
    rows = segments.withColumn("key", word_key(F.col("text"))).withColumn("head", head("key"))
    rows = rows.join(exact.drop("_pos"), "key", "left").join(start, "head", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_prefix").isNotNull(), "prefix").otherwise("none")
    return rows.select(*segments.columns, F.coalesce("_exact", "_prefix").alias("speaker"), how.alias("match"))
