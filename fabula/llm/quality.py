"""Document rules and the frequency of lines across the documents of a host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import unused, written
from fabula.llm.wordhash import Words, slices

#: A line is boilerplate of its host if more than so many of a hundred of the host's documents have it, and more than so many in all.
PERCENT, FLOOR = 2, 5
#: A document is depleted if its lines that stay hold less than this share of its words, or fewer words.
MIN_SHARE, MIN_WORDS = 0.5, 10
#: Ways in which a host's frequent line is dealt out before it meets the documents that have it.
SALTS = 16

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each ``\\n``-split line, rows in order."""
    cut = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.offsets[:-1], cut + 1]))
    row = np.searchsorted(words.offsets[:-1], start, side="right") - 1
    # A newline that ends a row's text opens an empty line at the next row's start: it has no word.
    end = np.concatenate([start[1:], [len(words.data)]])
    ends_line = np.zeros(len(words.data) + 1, dtype=bool)
    ends_line[cut + 1] = True
    end = end - (ends_line[end] & (end > start))
    return start, end, row


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to another of its row, is equal to an earlier one of its row)."""
    order = np.lexsort((np.arange(len(key)), key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    any_, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def _per_row(row: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(np.int64)


def _keyed_lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row, number of words and key of each line.  A line's key is a hash of its words in
    lower case (A-Z), whatever stands between them."""
    start, end, row = _lines(words)
    at = np.searchsorted(words.start, start)
    held = np.searchsorted(words.start, end) - at
    low = Words(words.data, words.offsets, lower=True)
    back = np.concatenate([[np.uint64(0)], np.cumsum(low.hash * _rank_weight(len(low.hash)))])
    return start, end, row, held, _line_key(back, at, held)


def _measured(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for _, data, offsets in slices(batch.column("text")):
            n = len(offsets) - 1
            words = Words(data, offsets)
            char = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~words.space)])
            symbol = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
            n_words = np.diff(words.row_start)
            first, window = words.windows(5)
            again, _ = _repeated(words.row[first], window)
            cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
            np.add.at(cover, first[again], 1)
            np.add.at(cover, first[again] + 5, -1)
            covered = np.cumsum(cover[:-1]) > 0
            some = np.flatnonzero((lines := _keyed_lines(words))[3] > 0)
            start, end, row, held, key = (x[some] for x in lines)
            _, later = _repeated(row, words.span_hash(start, end))
            uniq, inverse = np.unique(np.stack([row.astype(np.uint64), key]), axis=1, return_inverse=True) if len(row) else (np.zeros((2, 0), np.uint64), np.zeros(0, int))
            total = np.bincount(inverse.reshape(-1), weights=held, minlength=uniq.shape[1]).astype(np.int64)
            bound = np.searchsorted(uniq[0], np.arange(n + 1, dtype=np.uint64))
            out[0] += n_words.tolist()
            out[1] += (char[offsets[1:]] - char[offsets[:-1]]).tolist()
            out[2] += (symbol[offsets[1:]] - symbol[offsets[:-1]]).tolist()
            out[3] += _per_row(row[later], n).tolist()
            out[4] += _per_row(words.row[covered], n).tolist()
            hashes = uniq[1].view(np.int64)
            out[5] += [[{"h": h, "w": w} for h, w in zip(hashes[a:b].tolist(), total[a:b].tolist(), strict=True)] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        ints = [pa.array(x, pa.int64()) for x in out[:5]]
        lines = pa.array(out[5], pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host_key"), batch.column("uid"), *ints, lines],
            ["doc_id", "host_key", "uid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


_WEIGHT = np.uint64(0xD6E8FEB86659FD93)
_UNWEIGHT = np.uint64(pow(int(_WEIGHT), -1, 2**64))


def _rank_weight(n: int) -> np.ndarray:
    full = np.full(n, _WEIGHT, dtype=np.uint64)
    full[:1] = 1
    return np.cumprod(full, dtype=np.uint64)


def _line_key(back: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Hash of ``held`` words from the word ``at``, from prefix sums of their weighted hashes."""
    from fabula.llm.wordhash import mix

    full = np.full(len(back), _UNWEIGHT, dtype=np.uint64)
    full[:1] = 1
    shift = np.cumprod(full, dtype=np.uint64)
    return mix((back[at + held] - back[at]) * shift[at] + held.astype(np.uint64))


def _uid(id_col: str, text_col: str, host_col: str) -> Column:
    """Documents are told apart by id, text and host."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), F.col(host_col).cast("string"))


def _judged(docs: DataFrame, floor: int, percent: int, min_share: float, min_words: int, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The columns of ``quality``, uid, and ``gone``: the keys of a document's boilerplate lines."""
    few = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(host_col).cast("string")).alias("host_key"), F.col(text_col).alias("text"), _uid(id_col, text_col, host_col).alias("uid")
    )
    schema = "doc_id long, host_key long, uid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: long, w: long>>"
    rows = written(few.mapInArrow(_measured, schema), "lines")
    # One row for each document and line, salted by document: a line that very many share is counted in parts.
    lines = rows.select("uid", "host_key", F.explode("lines").alias("l"))
    lines = lines.select("uid", "host_key", F.xxhash64("host_key", "l.h").alias("line"), F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    seen = lines.dropDuplicates(["uid", "line"])
    # A line is of one host, so its count has the host's key.
    often = seen.groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.first("host_key").alias("host_key")).filter(F.col("documents") > floor)
    hosts = rows.select("uid", "host_key").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("of_host"))
    often = often.join(hosts, "host_key").filter(100 * F.col("documents") > percent * F.col("of_host")).select("line")
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = seen.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(often, ["line", "salt"], "left_semi")
    lost = met.groupBy("uid").agg(F.sum("w").alias("lost"), F.collect_list("h").alias("gone"))
    out = rows.drop("lines").join(lost, "uid", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stays = F.col("n_words") - F.col("lost")
    depleted = (stays < min_words) | (stays < min_share * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("lost").alias("n_boilerplate_words"), (~failed & ~depleted).alias("kept"), "uid", "gone",
    )


def quality(
    docs: DataFrame,
    floor: int = FLOOR,
    percent: int = PERCENT,
    min_share: float = MIN_SHARE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Judge each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_boilerplate_words, kept.

    A line (its words, A-Z lower-cased) is boilerplate if over ``percent`` of a hundred different documents
    of its host have it, and more than ``floor`` in all.  A document is kept unless the rules fail it, or
    its other lines hold under ``min_words`` words or under ``min_share`` of its words.  Null hosts are one
    host; a null text is empty and so fails.  Documents are told apart by id, text and host, so rows that repeat
    one count once and are judged alike.  An empty table gives an empty result.  Other columns are not carried.
    """
    return _judged(docs, floor, percent, min_share, min_words, id_col, text_col, host_col).drop("uid", "gone")


def cleaned(
    docs: DataFrame,
    floor: int = FLOOR,
    percent: int = PERCENT,
    min_share: float = MIN_SHARE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Rows of ``docs`` that ``quality`` keeps, their text without its boilerplate lines, all other columns as they were."""
    uid, ident, gone = unused(docs.columns, "uid", "of", "gone")
    judged = _judged(docs, floor, percent, min_share, min_words, id_col, text_col, host_col).filter("kept")
    judged = judged.select(F.col("uid").alias(ident), F.col("gone").alias(gone)).dropDuplicates([ident])
    met = docs.withColumn(uid, _uid(id_col, text_col, host_col)).join(judged, F.col(uid) == F.col(ident)).drop(uid, ident)

    def without(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for k, keys in enumerate(batch.column(gone).to_pylist()):
                if keys:
                    data = np.frombuffer(texts[k].encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    _, _, _, held, key = _keyed_lines(Words(data, np.array([0, len(data)])))
                    out = set(keys)
                    lines = zip(texts[k].split("\n"), held.tolist(), key.view(np.int64).tolist(), strict=True)
                    texts[k] = "\n".join(line for line, n, h in lines if not (n and h in out))
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select([c for c in batch.schema.names if c != gone])

    return met.mapInArrow(without, docs.schema)
