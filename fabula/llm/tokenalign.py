"""Alignment of two tokenizers' tokens over the same bytes, and how often the corpus links their ids.

Each tokenizer cuts a text's bytes at its cumulative token ends.  Merging the two sorted lists of ends
gives the links (between two neighbouring ends of the merged list lies exactly one token of each side)
and the groups (they close where both lists have an end).  This runs inside ``mapInPandas``, text by
text.  What follows is Spark's: links of each id pair are counted over the corpus, the highest count of
each id of either side is found, and both are joined back to the documents' links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.bpe import encoder
from fabula.llm.shared import written

#: Bits of the second side's id in the number of a pair.
SIDE = 32
#: Links after which a batch of documents is handed on.
BATCH_LINKS = 1_000_000

_pieces: dict[str, "_Pieces"] = {}


class _Pieces:
    """A sentence-piece model with the bytes of each id; the mark U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in names]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int64)


class _Labels:
    """The decimal ids with each mark that can follow them."""

    def __init__(self, size: int, within: str, last: str):
        self.table = np.array([[f"{i}{within}" for i in range(size)], [f"{i}{last}" for i in range(size)]], dtype=object)

    def of(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.table[last.astype(np.int64), ids]


class Merge(NamedTuple):
    """Links as places in the two token lists, in order, and which links close a group."""

    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> Merge:
    """Merge two ascending lists of ends that share their last one."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")  # two sorted runs: a linear merge
    ends = both[np.append(both[1:] != both[:-1], True)]
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return Merge(a, b, ends_a[a] == ends_b[b])


def groups_text(a: np.ndarray, b: np.ndarray, links: Merge, label_a: _Labels, label_b: _Labels) -> str:
    """``a1,a2|b1;a3|b2,b3``: each group's ids of either side, in order."""
    close = np.flatnonzero(links.closes)
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[links.a[close]] = True
    last_b[links.b[close]] = True
    # A token stands after all tokens before it on its own side and those of the other side in the groups before (b: and in its own).
    upto_a, upto_b = links.a[close] + 1, links.b[close] + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = label_a.of(a, last_a)
    out[np.arange(len(b)) + upto_a[group_b]] = label_b.of(b, last_b)
    return "".join(out.tolist())[:-1]


def _aligned(batches: Iterator[pd.DataFrame], path_a: str, path_b: str) -> Iterator[pd.DataFrame]:
    side_a = encoder(path_a)
    if path_b not in _pieces:
        _pieces[path_b] = _Pieces(path_b)
    side_b = _pieces[path_b]
    bytes_a, bytes_b = side_a.token_bytes, side_b.token_bytes
    size_a, size_b = np.array(list(map(len, bytes_a))), np.array(list(map(len, bytes_b)))
    label_a, label_b = _Labels(len(bytes_a), ",", "|"), _Labels(len(bytes_b), ",", ";")
    none = np.zeros(0, dtype=np.int64)
    columns = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n"]

    def one(text: str | None) -> tuple:
        if isinstance(text, str) and text:
            whole = (" " + text).encode()
            a, b = np.frombuffer(side_a.spaced_ids(text), dtype="<u4").astype(np.int64), side_b.ids(text)
            if b"".join([bytes_a[i] for i in a.tolist()]) == whole and b"".join([bytes_b[i] for i in b.tolist()]) == whole:
                links = merged(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
                digest = hashlib.sha256(groups_text(a, b, links, label_a, label_b).encode()).hexdigest()
                pair, n = np.unique(a[links.a] << SIDE | b[links.b], return_counts=True)
                return len(a), len(b), int(links.closes.sum()), len(links.a), digest, pair, n
        return 0, 0, 0, 0, "", none, none

    for batch in batches:
        rows, held = [], 0
        for row, key, text in zip(batch["row"], batch["id"], batch["text"], strict=True):
            rows.append((row, key, *one(text)))
            held += len(rows[-1][-1])
            if held >= BATCH_LINKS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)


ALIGNED = "row long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, n array<long>"


def documents_aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, a row for each document: numbers of tokens, groups and links, the digest of its groups, and its distinct
    id pairs (``pair``: the first side's id, then 32 bits of the second's) with how many of its links hold them (``n``).

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentence-piece model that puts a space before a text; the first encodes a space and the text,
    so that both cut the same bytes.  Texts null, empty, or not given back byte by byte by either side have no tokens: zeros and ''.
    """
    few = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return written(few.mapInPandas(lambda batches: _aligned(batches, path_a, path_b), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Every linked id pair of the corpus: pair, a, b, count, best_a and best_b (no pair of that id has a higher count; ties included)."""
    links = aligned.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", SIDE).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SIDE) - 1)).alias("b"), "count")
    top = lambda side: F.col("count") == F.max("count").over(Window.partitionBy(side))  # noqa: E731  at most as many rows as the other side has ids
    return counts.select("*", top("a").alias("best_a"), top("b").alias("best_b"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: its id, n_a, n_b, n_groups, n_links, n_best_a and n_best_b (links whose pair has the highest count in the corpus of
    all pairs with its first or second id), count_sum (over its links) and groups_sha256.

    Null and repeated ids are fine: each row is a document.  Repeated texts count each time.  An empty table gives an empty
    result.  Columns other than those named take no part.
    """
    aligned = documents_aligned(docs, path_a, path_b, id_col, text_col)
    counts = written(pair_counts(aligned), "pairs")
    links = aligned.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("row", "x.pair", "x.n")
    over = lambda what: F.sum(F.when(what, F.col("n")).otherwise(F.lit(0))).alias
    sums = links.join(counts.select("pair", "count", "best_a", "best_b"), "pair").groupBy("row")
    sums = sums.agg(over(F.col("best_a"))("n_best_a"), over(F.col("best_b"))("n_best_b"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = aligned.drop("pair", "n").join(sums, "row", "left")
    kind = docs.schema[id_col].dataType
    or_0 = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", or_0("n_best_a"), or_0("n_best_b"), or_0("count_sum"), "groups_sha256")
