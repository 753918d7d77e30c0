"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import pieces, written

#: Labelled rows from which weights are learned, the first by a hash of their ids.
MAX_TRAIN_ROWS = 20_000
#: A learned entry is in at least so many toxic training documents ...
MIN_SUPPORT = 8
#: ... and so many times likelier there than in others.
MIN_ODDS = 20.0
#: An entry is a whole word of any length, or the first letters of words: so many.
MIN_PREFIX, MAX_PREFIX = 4, 32
#: In scripts that put no spaces between words, an entry is so many letters in a row, wherever they stand.
MIN_RUN, MAX_RUN = 2, 6
# Thai, Lao, Tibetan, Myanmar, Khmer, kana and Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")

# Insults known before any label is seen.
SEED_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
# Phrases in which an entry is harmless.
EXCEPTIONS = ("class clown", "clown fish", "trash bag", "trash bin", "trash can", "trash collection")
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Fold(dict):
    """Code point to folded text: Latin letters without marks, homoglyphs and digits as the letters
    they stand for, invisible characters gone, letters of other scripts as they are, all else a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        out = DIGITS.get(char) or HOMOGLYPHS.get(char)
        if out is None:
            base = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
            base = "".join(DIGITS.get(c) or HOMOGLYPHS.get(c) or c for c in base)
            if unicodedata.category(char) in ("Cf", "Mn"):
                out = ""
            else:
                out = base if base.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Words of ``text`` between single spaces or more, with a space at either end."""
    return " " + (text or "").lower().translate(_FOLD) + " "


#: Forms that a task counts before it hands the counts on.
TASK_FORMS = 200_000


def _forms(word: str) -> list[str]:
    """What an entry may be for a word: its beginnings, itself with the space after it, and of unspaced scripts the letters in a row."""
    own = [word[:n] for n in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1)] + [word + " "]
    if not word.isascii():
        for run in UNSPACED.findall(word):
            own += [run[k : k + n] for n in range(MIN_RUN, MAX_RUN + 1) for k in range(len(run) - n + 1)]
    return own


def _form_counts(batches, known: frozenset[str] | None = None):
    """In how many documents of a partition each form occurs, of all forms or of the ``known``."""
    counts: Counter = Counter()
    memo: dict[str, list[str]] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            own: set[str] = set()
            for word in set(folded(text).split()):
                if known is None:
                    own.update(_forms(word))
                    continue
                if len(word) > MAX_PREFIX:
                    own.update(f for f in _forms(word) if f in known)
                    continue
                if word not in memo:
                    if len(memo) >= TASK_FORMS:
                        memo.clear()
                    memo[word] = [f for f in _forms(word) if f in known]
                own.update(memo[word])
            counts.update(own)
            if len(counts) > TASK_FORMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])
                counts = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])


def _entries(table: list, n_toxic: int, n_other: int) -> dict[str, float]:
    """Entries with their log odds.  Of entries that stand for the same words, the longest; none that is
    rarer than one it begins with (which has ``MAX_PREFIX`` letters and a space at most).  A longer word is an entry only
    where its beginning is none: that stands for the word as well."""
    found = {r["entry"]: (r["toxic"], math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["other"] + 0.5) / (n_other + 1))) for r in table}
    longer: Counter = Counter()
    for entry, (n, _) in found.items():
        longer[entry[:-1]] = max(longer[entry[:-1]], n)
    return {
        entry: weight
        for entry, (n, weight) in found.items()
        if longer[entry] < 0.95 * n and (len(entry) <= MAX_PREFIX + 1 or entry[:MAX_PREFIX] not in found) and not any(found.get(entry[:k], (0,))[0] > 1.05 * n for k in range(1, min(len(entry), MAX_PREFIX + 2)))
    }


class Lexicon:
    """Entries with weights, and the curve from a text's weight to a probability.

    The weight of a text is the sum of its matches' weights, divided by the square root of its number
    of words (in hundreds, one at least); ``curve`` is (intercept, slope) on its logarithm.

    An entry matches at the start of a word, and with a space at its end only where the word ends too; one of letters of
    unspaced scripts matches anywhere."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, curve: tuple[float, float] = (-2.0, 4.0)):
        self.weights, self.exceptions, self.curve = weights, tuple(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                entry = entry if UNSPACED.fullmatch(entry) else " " + entry
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(" " + folded(phrase).strip() + " ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def weight(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        own = folded(text)
        hits, harmless = [], []
        for end, (size, weight) in self._built().iter(own):
            (harmless if weight is None else hits).append((end + 1 - size, end + 1, weight))
        # Of entries that start at one place, the longest counts (ends ascend, so it is the last).
        longest = {start: (end, weight) for start, end, weight in hits}
        harmless.sort()
        total, at, reach = 0.0, 0, 0
        for start, (end, weight) in sorted(longest.items()):
            while at < len(harmless) and harmless[at][0] <= start:
                reach, at = max(reach, harmless[at][1]), at + 1
            if end > reach:
                total += weight
        if not total:
            return 0.0
        return total / math.sqrt(max(1.0, own.count(" ") / 100))

    def score(self, weight: float) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(weight)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _fit_curve(weights: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log(1 + weight), a little regularised, by Newton's method."""
    x = np.stack([np.ones(len(weights)), np.log1p(weights)], axis=1)
    prior = beta = np.array([-2.0, 4.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - (beta - prior))
        beta = beta + step * min(1.0, 0.5 / max(abs(step).max(), 1e-12))  # short steps: classes that separate have no optimum near
        if abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def learn(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Lexicon:
    """A lexicon from rows (doc_id, text, toxic), of which the first ``max_rows`` by a hash of the id are
    used.  Entries are whole words of any length and beginnings of words, so that inflected forms count, and letters in a row of
    scripts without spaces; all that are frequent and telling enough.  Rows with null text or label teach
    nothing; equal texts count once; without rows the seed words have the weight of ``MIN_ODDS``."""
    rows = labelled.filter("text is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(max_rows).select("doc_id")
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["h"]).select("text", "toxic")
    sample = written(sample, "labelled")  # ``max_rows`` texts at most
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = seen.get(1, 0), seen.get(0, 0)
    # Forms that enough toxic texts have; in the other texts only these are counted.
    toxic = sample.filter("toxic = 1").mapInArrow(_form_counts, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("toxic"))
    toxic = {r["entry"]: r["toxic"] for r in toxic.filter(F.col("toxic") >= MIN_SUPPORT).collect()}  # forms of ``max_rows`` texts at most
    known = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))
    other = sample.filter("toxic = 0").mapInArrow(lambda b: _form_counts(b, known.value), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("other"))
    other = {r["entry"]: r["other"] for r in other.collect()}  # some of the same forms
    odds = lambda e: (toxic[e] + 0.5) / (n_toxic + 1) / ((other.get(e, 0) + 0.5) / (n_other + 1))
    table = [{"entry": e, "toxic": n, "other": other.get(e, 0)} for e, n in toxic.items() if odds(e) >= MIN_ODDS]
    weights = dict.fromkeys(SEED_WORDS, math.log(MIN_ODDS)) | _entries(table, n_toxic, n_other)
    lexicon = Lexicon(weights)

    def weighed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.weight(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], ["w", "toxic"])

    seen = sample.mapInArrow(weighed, "w double, toxic int").toArrow()  # two numbers for each of ``max_rows`` rows at most
    if seen.num_rows:
        lexicon.curve = _fit_curve(seen.column("w").to_numpy(), seen.column("toxic").to_numpy().astype(float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each row of ``docs``: doc_id, score, predicted (1 if score >= 0.5).  Null and empty texts
    have the score of a text without matches.  Other columns are not carried."""

    def run(batches):
        for batch in batches:
            scores = [lexicon.score(lexicon.weight(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all their columns as they were, whose text scores under 0.5."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                keep = [lexicon.score(lexicon.weight(t)) < 0.5 for t in piece.column(text_col).to_pylist()]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
