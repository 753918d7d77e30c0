"""Token ids of a byte-level BPE file, remembered by word; built in each Python worker.

Gives the ids that the file's own tokenizer gives.  Words that a single space sets apart are encoded
apart, as no token reaches over such a space.  White space of many characters in a row is a token
group of its own and never reaches the pattern, whose backtracking would not end on it.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

#: Words whose tokens a Python worker remembers.
CACHE_WORDS = 400_000
#: White space as the pattern knows it, in runs too long for it.
LONG = 512
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)

_encoders: dict[str, "Encoder"] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level BPE files write bytes: printable Latin-1 stands
    for itself, the rest is numbered from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder(dict):
    """Token ids (little-endian unsigned 32-bit) of a word with a space before it."""

    def __init__(self, path: str):
        import tiktoken

        from public_tokenizers import PATTERN

        to_byte = _byte_of_char()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.added = {content: _packed([i]) for content, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(to_byte[c] for c in token): i for token, i in self.vocab.items() if token not in added and all(c in to_byte for c in token)}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        to_byte = _byte_of_char()
        out = [b""] * (1 + max(self.vocab.values()))
        for token, i in self.vocab.items():
            out[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        return out

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(" " + word)
        if len(word) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text as it stands.  Of a long run of white space, the pattern gives all but the last character
        to one group, or all of it at the end of a text; the last one goes with what follows."""
        if len(text) < LONG:
            return _packed(self.encoding.encode_ordinary(text))
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [_packed(self.encoding.encode_ordinary(text[at : run.start()])), _packed(self.encoding._encode_single_piece(text[run.start() : end]))]
            at = end
        return b"".join([*out, _packed(self.encoding.encode_ordinary(text[at:]))]) if out else _packed(self.encoding.encode_ordinary(text))

    def text_ids(self, text: str) -> bytes:
        """Added tokens of the file are found first, wherever they stand; what lies between is encoded by itself."""
        if self.cut is None or not self.cut.search(text):
            return self.plain_ids(text)
        return b"".join([self.added[part] if k % 2 else self.plain_ids(part) for k, part in enumerate(self.cut.split(text))])

    def plain_ids(self, text: str) -> bytes:
        """Strings of added tokens are ordinary text here.  A single space between two words always starts a token
        of its own, so words can be encoded apart; a text with other white space beside a space is encoded whole."""
        words = text.split(" ")
        if len(words) == 1:
            return self.ids(text)
        if "" in words or any(w[0].isspace() or w[-1].isspace() for w in words):
            return self.ids(text)
        return self.ids(words[0]) + b"".join([self[w] for w in words[1:]])

    def spaced_ids(self, text: str) -> bytes:
        """Ids of a space and the text; strings of added tokens are ordinary text."""
        words = text.split(" ")
        if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            return self.ids(" " + text)
        return b"".join([self[w] for w in words])


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file at ``path``, which is the same on every machine."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
