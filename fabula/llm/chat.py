"""Chat formatting with a grammar round trip.

    conversation = turn*          turn = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Inside a role or text, ``<``, any number of backslashes and ``|`` stand for the same with one backslash
less (if there is any), and in a role ``%0A`` and ``%25`` for a newline and ``%``.  A turn is rendered as
it is, parsed again and compared with its source; what differs is escaped and rendered again, until the
parser gives back the source.  One round is enough, as escaping leaves no ``<|`` and parsing undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class Unparsable(ValueError):
    """Text that the grammar does not produce."""


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the raw text in ``rendered``."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise Unparsable(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        stop = rendered.find(END + "\n", line + 1) if line >= 0 else -1
        if stop < 0:
            raise Unparsable(f"the turn at {at} does not end")
        body = rendered[line + 1 : stop]
        if START in body or END in body:
            raise Unparsable(f"a control string inside the turn at {at}")
        yield unescape_role(rendered[at + len(START) : line]), unescape(body), line + 1, stop
        at = stop + len(END) + 1


def render(role: str, text: str) -> str:
    """One turn, with as little escaped as gives role and text back."""
    as_role, as_text = role, text
    while True:
        rendered = f"{START}{as_role}\n{as_text}{END}\n"
        try:
            turns = [(r, t) for r, t, _, _ in parse(rendered)]
        except Unparsable:
            turns = []
        if turns == [(role, text)] and START not in as_role and END not in as_role:
            return rendered
        got = turns[0] if len(turns) == 1 else (None, None)
        new_role = as_role if got[0] == role and "<|" not in as_role else escape_role(role)
        new_text = as_text if got[1] == text else escape(text)
        if (new_role, new_text) == (as_role, as_text):
            raise Unparsable("escaping does not help")
        as_role, as_text = new_role, new_text


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Render each row of ``turns`` (conv_id, turn, role, text): conv_id, turn, rendered, loss, where loss is
    (start, end) of the raw text in ``rendered`` if the role is ``loss_role``, else null.

    The texts of a conversation are its turns' in the order of ``turn`` (nulls first, ties by role and
    text), one after another: every turn is rendered by itself, so a conversation of any length is
    spread over the cluster.  Null roles and texts are empty.  Other columns are not carried."""

    def run(batches):
        for batch in batches:
            out, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rendered = render(role or "", text or "")
                ((_, _, a, b),) = parse(rendered)
                out.append(rendered)
                start.append(a if role == loss_role else None)
                end.append(b if role == loss_role else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["conv_id", "turn", "rendered", "start", "end"],
            )

    few = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    out = few.mapInArrow(run, "conv_id long, turn long, rendered string, start long, end long")
    return out.select("conv_id", "turn", "rendered", F.when(F.col("start").isNotNull(), F.struct("start", "end")).alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """Parse the rendered turns again and digest each conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Rows are sorted and streamed: a task holds one turn and two running digests, not a conversation."""

    def run(batches):
        now, seen = None, False
        count = chars = total = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def close():
            done.append((now, count, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for row in batch.select(["conv_id", "rendered", "start", "end"]).to_pylist():
                if seen and row["conv_id"] != now:
                    close()
                    count = chars = total = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                now, seen = row["conv_id"], True
                total += len(row["rendered"])
                for role, text, _, _ in parse(row["rendered"]):
                    count += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if row["start"] is not None:
                    masked = unescape(row["rendered"][row["start"] : row["end"]])
                    chars += len(masked)
                    loss.update(masked.encode("utf-8", "surrogatepass"))
            if done:
                yield _digests(done)
                done.clear()
        if seen:
            close()
            yield _digests(done)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = output.select("conv_id", "turn", "rendered", F.col("loss.start").alias("start"), F.col("loss.end").alias("end"))
    order = ["conv_id", "turn", "rendered"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _digests(done: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
