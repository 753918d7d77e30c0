"""Replacement of a lexicon's terms in text: one scan for all terms, however many there are.

The result is that of replacing the terms one after another, longest first, each wherever it stands as a word
of its own.  An automaton finds the places of all terms at once; where places overlap, the longest term has its way.
The outcome is then scanned once more: only where a replacement gave rise to a term that is still to come
(or a term begins or ends with a sign, so that its neighbours may grow together) are terms taken one at a time,
and then only those that occur.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a lexicon that is read from a table: it goes to every task.
MAX_TERMS = 200_000


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Replacer:
    """Terms and what is said for them, a replacement template of ``re``; empty terms are left out."""

    def __init__(self, lexicon: Mapping[str, str]):
        self.terms = sorted((t for t in lexicon if t), key=lambda t: (-len(t), t))
        self.said = [lexicon[t] for t in self.terms]
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _places(self, text: str) -> list[tuple[int, int, int]]:
        """(rank, start, end) of every term that stands between word boundaries."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for rank, term in enumerate(self.terms):
                self._automaton.add_word(term, rank)
            self._automaton.make_automaton()
        out = []
        for last, rank in self._automaton.iter(text):
            term, end = self.terms[rank], last + 1
            start = end - len(term)
            before = start > 0 and _in_word(text[start - 1])
            after = end < len(text) and _in_word(text[end])
            if before != _in_word(term[0]) and after != _in_word(term[-1]):
                out.append((rank, start, end))
        return out

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.terms:
            return text
        places = self._places(text)
        if not places:
            return text
        if not all(_in_word(self.terms[r][0]) and _in_word(self.terms[r][-1]) for r, _, _ in places):
            return self._one_by_one(text)
        taken, chosen = bytearray(len(text)), []
        for rank, start, end in sorted(places):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                chosen.append((start, end, rank))
        chosen.sort()
        parts, spans, at, size = [], [], 0, 0
        for start, end, rank in chosen:
            new = self._said(rank)
            parts += [text[at:start], new]
            size += start - at
            spans.append((size, size + len(new), rank))
            size, at = size + len(new), end
        out = "".join([*parts, text[at:]])
        k = 0
        for rank, start, end in sorted(self._places(out), key=lambda p: p[2]):
            while k < len(spans) and spans[k][1] < start - len(self.terms[0]):
                k += 1
            for first, last, earlier in spans[k:]:
                if first > end:
                    break
                if last >= start and earlier < rank:
                    return self._one_by_one(text)
        return out

    def _said(self, rank: int) -> str:
        said = self.said[rank]
        return said if "\\" not in said else re.fullmatch(re.escape(self.terms[rank]), self.terms[rank]).expand(said)

    def _one_by_one(self, text: str) -> str:
        done = -1
        while (rank := min((r for r, _, _ in self._places(text) if r > done), default=None)) is not None:
            text, done = re.sub(rf"\b{re.escape(self.terms[rank])}\b", self.said[rank], text), rank
        return text


def replaced_in(rows: DataFrame, column: str, lexicon: Mapping[str, str]) -> DataFrame:
    """``rows`` with the lexicon's terms replaced in ``column``; nulls stay, as do all other columns."""
    replacer, at = Replacer(lexicon), rows.columns.index(column)

    def run(batches):
        for batch in batches:
            said = pa.array([replacer(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([said if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def replaced_by_row(rows: DataFrame, column: str, lexicon: str) -> DataFrame:
    """``rows`` with the terms of each row's own lexicon, a map column, replaced in ``column``; rows with a null map stay as they are."""
    at, of = rows.columns.index(column), rows.columns.index(lexicon)

    def run(batches):
        for batch in batches:
            made: dict[tuple, Replacer] = {}

            def one(text, terms):
                if text is None or terms is None:
                    return text
                key = tuple(sorted(terms))
                if key not in made:
                    made[key] = Replacer(dict(key))
                return made[key](text)

            said = pa.array([one(t, m) for t, m in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([said if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def lexicon_of(table: DataFrame, term: str = "term", said: str = "said", most: int = MAX_TERMS) -> dict[str, str]:
    """The lexicon in a table that people have written: each term once (of several, the least said), nulls left out.
    It must have ``most`` terms or fewer, as every task has it whole; beyond that, replace by row with a map of each book's own."""
    rows = table.filter(F.col(term).isNotNull() & F.col(said).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.min(said).alias("said")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon has {most} terms at most")
    return {r.term: r.said for r in rows}
