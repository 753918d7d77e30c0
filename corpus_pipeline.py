"""A training corpus from ``documents``: toxic texts out, near duplicates down to one, secrets masked,
sources mixed to their weights, and the result packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import mixing, neardup, packing, queries, secrets, toxicity
from fabula.llm.shared import unused, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, with a lexicon learned from the labelled ones among them."""
    return toxicity.accepted(docs, queries.toxicity_lexicon(docs, spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.75 or more)."""
    return neardup.deduplicated(docs, percent=75)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows where a text changes."""
    (was,) = unused(docs.columns, "was")
    clean = secrets.redacted(docs.withColumn(was, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(was))
    size = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, shard by shard in shuffled order.  Where a source's
    quota ends within a document, its words up to there, with the white space between them."""
    (row,) = unused(docs.columns, "row")
    whole = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = mixing.sharded(mixing.mixed(whole, weights=(3, 1, 2), share=1.5, repeats=2, carry=[row]))
    words = F.regexp_extract_all(F.col(f"{row}.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""))
    size = F.coalesce(F.length(cut), F.col(f"{row}.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.coalesce(cut, F.col(f"{row}.text")), "n_chars": size}
    return rows.select(*[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.digest(docs, queries.tokenizer_path(), capacity=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned weights, confirmed signatures and token ids are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
