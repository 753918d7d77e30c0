"""Alignment of whole chapters by an aligner for short spans: blocks of words, each anchored at the end of the one before.

An aligner is any picklable function (chapter_id, words, from_s, to_s) to a (start, end, score) for each word,
in seconds after ``from_s``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Aligner = Callable[[int, Sequence[str], float, float], Sequence[tuple[float, float, float]]]

# Words of a block, those at its end that are aligned again, the share and seconds of audio it may
# need beyond its words' average, audio frames a second, and the most cells an alignment may have.
BLOCK, TAIL = 1200, 150
MARGIN, PAD_S = 1.7, 15.0
FRAMES, CELLS = 50.0, 1.6e9
#: Words that leave a task at once, or those of one chapter.
ROWS = 50_000


def word_blocks(words: Column, block: int = BLOCK, tail: int = TAIL) -> Column:
    """Blocks of ``words`` words: array of (first, last, kept), from 0 and exclusive; all but a chapter's last block
    keep everything before their tail, and the next one starts there."""
    step = max(1, block - tail)
    count = F.when(words <= 0, 0).when(words <= block, 1).otherwise(F.ceil((words - block) / F.lit(step)).cast("int") + 1)
    one = lambda k: F.struct(
        (k * step).alias("first"), F.least(k * step + block, words).alias("last"), F.when(k == count - 1, words).otherwise((k + 1) * step).alias("kept")
    )
    every = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)
    return F.when(count > 0, every).otherwise(F.slice(every, 1, 0))


def aligned(chapters: DataFrame, aligner: Aligner, block: int = BLOCK, tail: int = TAIL, cells: float = CELLS) -> DataFrame:
    """Times of each word of ``chapters`` (chapter_id, words array<string>, seconds): chapter_id, idx, word, start, end, score.

    A chapter whose frames times letter states stay within ``cells`` is aligned at once.  A longer one goes block by
    block: where a block starts depends on where the one before ended, so a chapter is one row and its blocks are
    one loop; chapters are independent.  Null or no words give no rows."""

    def spans(chapter: int, words: list[str], seconds: float) -> np.ndarray:
        if seconds * FRAMES * (2 * sum(map(len, words)) + 1) <= cells:
            return _times(aligner(chapter, words, 0.0, seconds))
        done, at, begin = [], 0, 0.0
        per_word = seconds / len(words)
        while at < len(words):
            part = words[at : at + block]
            final = at + len(part) == len(words)
            room = seconds - begin
            if not final:
                room = min(room, len(part) * per_word * MARGIN + PAD_S)
            times = aligner(chapter, part, begin, begin + room)
            kept = _times(times if final else times[: max(1, block - tail)])
            done.append(kept + np.array([begin, begin, 0.0]))
            begin += float(kept[-1, 1]) if kept[-1, 1] > 0 else room
            at += len(kept)
        return np.concatenate(done)

    def run(batches):
        for batch in batches:
            found, size = [], 0
            words, seconds = batch.column("words"), batch.column("seconds")
            for k, chapter in enumerate(batch.column("chapter_id").to_pylist()):
                own = words[k].values
                if own is None or not len(own):
                    continue
                length = seconds[k].as_py()
                times = spans(chapter, own.to_numpy(zero_copy_only=False).tolist(), math.nan if length is None else length)[: len(own)]
                found.append((k, own[: len(times)], times))
                size += len(times)
                if size >= ROWS:
                    yield _rows(batch, found)
                    found, size = [], 0
            if found:
                yield _rows(batch, found)

    return chapters.select(F.col("chapter_id").cast("long").alias("chapter_id"), "words", F.col("seconds").cast("double").alias("seconds")).mapInArrow(
        run, "chapter_id long, idx int, word string, start double, end double, score double"
    )


def _times(times: Sequence[tuple[float, float, float]]) -> np.ndarray:
    return np.array(times, dtype=np.float64).reshape(-1, 3)


def _rounded(values: np.ndarray) -> np.ndarray:
    """``round(x, 3)`` of each value: scaled, but for those so near to a tie that scaling might decide it."""
    scaled = values * 1000
    out = np.rint(scaled) / 1000
    for k in np.flatnonzero(~(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) > 1e-4) | (np.abs(scaled) > 1e9)):
        out[k] = round(float(values[k]), 3)
    return out


def _rows(batch: pa.RecordBatch, found: list[tuple[int, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """The words of chapters, with their times, as one batch; the words themselves are taken over as they are."""
    lengths = [len(times) for _, _, times in found]
    times = np.concatenate([times for _, _, times in found])
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("chapter_id").take(pa.array(np.repeat([k for k, _, _ in found], lengths))),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])),
            pa.concat_arrays([words for _, words, _ in found]),
            number(_rounded(times[:, 0])), number(_rounded(times[:, 1])), number(times[:, 2]),
        ],
        ["chapter_id", "idx", "word", "start", "end", "score"],
    )
