"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import written

#: Buckets into which n-grams are hashed.
BUCKETS = 1 << 16
#: Numbers in a model's matrix (4 bytes each): with more than 256 languages, buckets are merged in pairs until it fits.
MODEL_NUMBERS = 1 << 24
#: Languages whose counts a task holds before it hands them on.
TASK_LANGUAGES = 128
SLICE_CHARS = 1 << 20
#: Stands between texts; no code point.
BETWEEN = 0xFFFFFFFF

_MULT = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def grams(texts: list[str | None]):
    """Slices of texts as (first row, bucket of each n-gram, row of each n-gram, rows).

    Texts are lower-cased; what is no letter counts as one space.  N-grams of one to three characters
    that hold a letter; none spans two texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < SLICE_CHARS):
            size += len(texts[end] or "")
            end += 1
        own = [(t or "").lower() for t in texts[at:end]]
        # Rows follow from lengths, as a text may hold any character.
        length = np.array([len(t) + 1 for t in own])
        raw = np.frombuffer(("\n" + "".join(t + "\n" for t in own)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.unique(raw)
        letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in seen.tolist()], dtype=bool)
        is_letter = letters[np.searchsorted(seen, raw)] if len(seen) > 512 else np.isin(raw, seen[letters])
        row = np.concatenate([[0], np.repeat(np.arange(len(own)), length)])
        code = np.where(is_letter, raw, np.uint32(32))
        code[np.concatenate([[0], np.cumsum(length)])] = BETWEEN
        keep = (code != 32) | np.concatenate(([True], code[:-1] != 32))
        code, row, is_letter = code[keep], row[keep], is_letter[keep]
        buckets, rows = [], []
        hashed = np.zeros(len(code), dtype=np.uint32)
        inside = np.ones(len(code), dtype=bool)
        some = np.zeros(len(code), dtype=bool)
        for n in range(3):
            m = len(code) - n
            hashed = (hashed[:m] ^ (code[n:] + np.uint32(n + 1))) * _MULT[n]
            hashed ^= hashed >> np.uint32(15)
            inside = inside[:m] & (code[n:] != BETWEEN)
            some = some[:m] | is_letter[n:]
            ok = inside & some
            buckets.append(((hashed[ok] * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64))
            rows.append(row[:m][ok])
        yield at, np.concatenate(buckets), np.concatenate(rows), end - at
        at = end


def _counted(batches):
    """Counts of each (language, bucket) of a partition, in parts if it has many languages."""
    total: dict[str, np.ndarray] = {}

    def counts():
        for lang, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some].astype(np.int64))], ["lang", "bucket", "n"]
            )
        total.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for at, bucket, row, n in grams(texts):
            own = np.array(langs[at : at + n], dtype=object)
            for lang in sorted(set(own.tolist())):
                if lang not in total and len(total) >= TASK_LANGUAGES:
                    yield from counts()
                total[lang] = total.get(lang, 0) + np.bincount(bucket[(own == lang)[row]], minlength=BUCKETS)
    yield from counts()


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities as a buckets x languages matrix) from all rows (text, lang).

    Counts are summed per partition and then by Spark.  What reaches the driver is one number for each
    bucket and language, at most ``MODEL_NUMBERS`` whatever the corpus: the buckets are as many as
    that leaves for the languages, ``BUCKETS`` at most."""
    counts = labelled.filter("lang is not null").select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long")
    counts = written(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    buckets = BUCKETS
    while buckets > 1 and buckets * counts.select("lang").distinct().count() > MODEL_NUMBERS:
        buckets //= 2
    # A row for each language, with a cell for each of its buckets: as many as the model has at most.
    cells = counts.groupBy("lang", F.pmod("bucket", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))
    table = cells.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang").toArrow()
    langs = table.column("lang").to_pylist()
    matrix = np.full((buckets, len(langs)), 0.1)
    if langs:
        own = table.column("cells").combine_chunks()
        of = np.repeat(np.arange(len(langs)), np.diff(own.offsets.to_numpy()))
        cell = own.flatten()
        np.add.at(matrix, (cell.field("bucket").to_numpy(zero_copy_only=False), of), cell.field("n").to_numpy(zero_copy_only=False))
        matrix = np.log(matrix / matrix.sum(axis=0, keepdims=True))
    return langs, np.ascontiguousarray(matrix.astype(np.float32))


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of each row of ``docs``: doc_id, lang_pred, score (posterior of the prediction).

    ``labelled`` has columns text and lang.  A text that is null or has no letter is ``und`` with score 0,
    as is every text where nothing was learned.  Rows with a null lang teach nothing; ties go to the
    language first in order.  Repeated rows are predicted alike.  Other columns are not carried."""
    langs, matrix = train(labelled)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def predict(batches):
        langs, matrix = shared.value
        for batch in batches:
            names, scores = [], []
            for _, bucket, row, n in grams(batch.column("text").to_pylist()):
                size = np.bincount(row, minlength=n)
                bucket %= len(matrix)
                if not langs:
                    names += ["und"] * n
                    scores += [0.0] * n
                    continue
                total = np.stack([np.bincount(row, weights=matrix[bucket, k], minlength=n) for k in range(len(langs))], axis=1)
                best = total.argmax(axis=1)
                odds = np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
                names += [langs[b] if s else "und" for b, s in zip(best.tolist(), size.tolist(), strict=True)]
                scores += [1.0 / o if s else 0.0 for o, s in zip(odds.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(predict, "doc_id long, lang_pred string, score double")
