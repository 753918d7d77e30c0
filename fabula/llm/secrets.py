"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_MIN = 20
HEX_MIN = 24
HEX = r"[0-9a-f]{%d,}" % HEX_MIN
KINDS = ("assign", "access", "hex", "entropy")

#: Length of the sliding window, and of the shortest candidate string.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes of a window, narrowest first: its characters, the bits that each must carry, and the digits it must hold.
CLASSES = (("0123456789abcdefABCDEF", 3.0, 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5, 1), ("abcdefghijklmnopqrstuvwxyz0123456789", 3.5, 2), (ALPHABET, 3.9, 1))
# Known examples, fillers and parts of web addresses; a window that touches one is no secret.
ALLOWED_WORDS = (
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "placeholder", "changeme", "abcdefgh", "12345678", "deadbeef", "example", "sample", "dummy", "https", "http", "www", "//",
)
UUID, UUID_CHARS = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", 36
#: A candidate all of whose parts are words or short numbers is a slug or a path.
PART_CUT, PLAIN_PART = "[-_/]", "^([A-Z]?[a-z]+|[0-9]{1,8})?$"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, then: str) -> str:
    """SQL for ``then`` with ``value`` computed once, under ``name``: names of lambdas, unlike columns, are never written out by the optimiser."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _prefix(values: str, op: str, then: str) -> str:
    """SQL for ``then``, in which ``pre(i)`` combines the elements of the array ``values`` (a name) before the i-th.

    The array is cut into about sqrt(n) runs: each element takes the total up to its run and adds the
    rest of its run, so that n elements cost n ** 1.5 steps and no array grows inside a fold."""
    total = {"sum": "aggregate({x}, 0L, (p, q) -> p + q)", "max": "coalesce(array_max({x}), 0L)"}[op]
    both = {"sum": "({x}) + ({y})", "max": "greatest({x}, {y})"}[op]
    runs = f"transform(sequence(0, (size({values}) - 1) div run), j -> {total.format(x=f'slice({values}, 1, cast(j as int) * run)')})"
    here = total.format(x=f"slice({values}, cast(i div run as int) * run + 1, cast(i % run as int))")
    own = both.format(x="runs[cast(i div run as int)]", y=here)
    return _let("run", f"cast(ceil(sqrt(size({values}))) as int)", _let("runs", runs, then.replace("pre(i)", f"({own})")))


#: Characters of a text's blocks, from which masked texts are put together.
BLOCK = 4096
SPANS = "array<struct<start: bigint, kind: int, end: bigint, token: string>>"


def _found(df: DataFrame, name: str, pattern: str, rank: int, hit: str, keep: str = "true", group: int = 0) -> DataFrame:
    """Add ``name``: the matches of ``pattern`` in ``_text`` as (start, rank, end, token), those that ``keep`` (of group g) allows."""
    lit = _sql(pattern)
    parts = f"named_struct('gap', transform(split(_text, {lit}, -1), x -> cast(length(x) as bigint)), 'grp', regexp_extract_all(_text, {lit}, {group}))"
    at = "transform(tok, (t, i) -> named_struct('start', pre(i) + m.gap[i], 'token', t, 'g', m.grp[i]))"
    kept = f"transform(filter(spans, s -> {keep}), s -> named_struct('start', s.start, 'kind', {rank}, 'end', s.start + length(s.token), 'token', s.token))"
    placed = _let("m", parts, _let("len", "transform(tok, (t, i) -> m.gap[i] + length(t))", _let("spans", _prefix("len", "sum", at), kept)))
    found = _let("tok", f"regexp_extract_all(_text, {lit}, 0)", f"if(size(tok) = 0, cast(array() as {SPANS}), {placed})")
    return df.withColumn(name, F.expr(f"if({hit}, {found}, cast(array() as {SPANS}))"))


def _bits(count: int) -> int:
    """count * log2(count), in millionths, so that sums are exact."""
    return round(count * math.log2(count) * 1e6) if count else 0


def most_bits(bits: float) -> int:
    """The largest sum of ``_bits`` over a window's counts at which each character carries ``bits``."""
    return round(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def _hot(token: str) -> str:
    """SQL for (first, last), the ends of the first and the last hot window of ``token``; last is 0 if there is none.

    The token is cut into symbols once.  A window's state follows from that of the one before by the
    symbol that enters (i) and the one that leaves (o): ``c`` holds the count of each symbol as one letter
    of a string, ``s`` the sum of count * log2(count), from which the entropy is log2(WINDOW) minus
    s / WINDOW, ``g`` how many of the window's symbols are of each class, digits and letters (a byte each),
    and ``clean`` the symbols since the last that belongs to an allowed word."""
    masked = f"regexp_replace({token}, '{UUID}', '{' ' * UUID_CHARS}')"
    for word in ALLOWED_WORDS:
        masked = f"regexp_replace({masked}, '(?i){word}', '{' ' * len(word)}')"
    symbols = f"transform(split({masked}, ''), x -> instr('{ALPHABET}', x))"

    digits, letters = "0123456789", ALPHABET[:52]
    member = [[int(x in chars) << (8 * k) for x in ALPHABET] for k, chars in enumerate([*(c for c, _, _ in CLASSES[:-1]), digits, letters])]
    tally = "array(0L, " + ", ".join(f"{sum(bits)}L" for bits in zip(*member, strict=True)) + ")"
    table = "array(" + ", ".join(f"{_bits(c)}L" for c in range(WINDOW + 2)) + ")"
    byte = lambda k: f"(shiftright(b.g, {8 * k}) & 255)"
    n_digits, n_letters = byte(len(CLASSES) - 1), byte(len(CLASSES))
    rules = [(f"{byte(k)} = {WINDOW}", b, d) for k, (_, b, d) in enumerate(CLASSES[:-1])]
    limit = "case " + " ".join(f"when {test} then if({n_digits} >= {d}, {most_bits(b)}L, -1L)" for test, b, d in rules) + f" else if({n_digits} >= {CLASSES[-1][2]}, {most_bits(CLASSES[-1][1])}L, -1L) end"

    i, o, full = "k[p - 1]", f"k[p - {WINDOW + 1}]", f"p > {WINDOW}"
    count = lambda x: f"(ascii(substr(a.c, {x} + 1, 1)) - 64)"
    put = lambda into, x, by: f"overlay({into}, chr(64 + {count(x)} + {by}), {x} + 1, 1)"
    stays = f"{full} and {o} = {i}"
    step = (
        f"named_struct('c', if({stays}, a.c, {put(f'if({full}, ' + put('a.c', o, -1) + ', a.c)', i, 1)}), "
        f"'s', if({stays}, a.s, a.s + {table}[{count(i)} + 1] - {table}[{count(i)}] + if({full}, {table}[{count(o)} - 1] - {table}[{count(o)}], 0L)), "
        f"'g', a.g + {tally}[{i}] - if({full}, {tally}[{o}], 0L), 'clean', if({i} = 0, 0, a.clean + 1), 'first', a.first, 'last', a.last)"
    )
    hot = f"b.clean >= {WINDOW} and {n_letters} > 0 and b.s <= {limit}"
    mark = f"b -> named_struct('c', b.c, 's', b.s, 'g', b.g, 'clean', b.clean, 'first', if(b.first = 0 and {hot}, p, b.first), 'last', if({hot}, p, b.last))"
    zero = f"named_struct('c', repeat('@', {len(ALPHABET) + 1}), 's', 0L, 'g', 0L, 'clean', 0, 'first', 0, 'last', 0)"
    fold = f"aggregate(sequence(1, size(k)), {zero}, (a, p) -> element_at(transform(array({step}), {mark}), 1), a -> named_struct('first', a.first, 'last', a.last))"
    return f"element_at(transform(array({symbols}), k -> {fold}), 1)"


def _scan(df: DataFrame) -> DataFrame:
    """Add ``spans`` to (row, _text)."""
    df = _found(df, "_assign", ASSIGN, 0, r"_text rlike '(?i:password|passwd|secret|token|api_?key)[\"\']?\\x20*[:=]'", f"length(s.g) >= {ASSIGN_MIN}", 2)
    df = _found(df, "_access", ACCESS, 1, "contains(_text, 'AKIA')", f"length(s.token) >= {ACCESS_MIN}")
    # One search finds whether there is any candidate, and so any hex string that is none.
    df = df.withColumn("_any", F.expr(f"_text rlike {_sql(CANDIDATE)}"))
    df = _found(df, "_hex", HEX, 2, "_any")
    slug = f"forall(split(s.token, '{PART_CUT}'), x -> x rlike '{PLAIN_PART}')"
    df = _found(df, "_long", CANDIDATE, 3, "_any", f"s.token rlike '[0-9]' and s.token rlike '[A-Za-z]' and not {slug}")
    df = df.withColumn("_hot", F.expr(f"if(size(_long) = 0, null, transform(_long, s -> named_struct('at', s.start, 'w', {_hot('s.token')})))"))
    # A pattern's spans (z) are sorted and apart, so only the last that starts no later than a hot span (h) can hold it.
    held = (
        "aggregate(sequence(0, 30), 0, (at, x) -> if(shiftleft(1, 30 - x) <= size(z) - at and z[at + shiftleft(1, 30 - x) - 1].start <= h.start, at + shiftleft(1, 30 - x), at), "
        "at -> at > 0 and z[at - 1].end >= h.end)"
    )
    kinds = "array(" + ", ".join(f"transform({x}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))" for x in ("_assign", "_access", "_hex")) + ")"
    added = f"transform(filter(_hot, h -> h.w.last > 0), h -> named_struct('start', h.at + h.w.first - {WINDOW}, 'kind', 3, 'end', h.at + h.w.last))"
    alone = f"filter({added}, h -> not exists(kinds, z -> {held}))"
    plain = "cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"
    bound = _let("kinds", kinds, f"array_sort(concat(flatten(kinds), coalesce({alone}, {plain})))")
    spans = f"if(size(_assign) + size(_access) + size(_hex) + size(_long) = 0, {plain}, {bound})"
    return df.select("row", "_text", F.expr(spans).alias("spans"))


def _rows(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns of a row in one struct, so that none can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))


def scanned(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add ``spans`` to ``docs``: an array of (start, kind, end), sorted, with kind an index of ``KINDS``;
    positions count code points, the end is exclusive.

    Patterns: ``assign`` (a name such as password, then ``=`` or ``:``, then a value of 6 or more
    characters), ``access`` and ``hex``, each leftmost without overlap.  Entropy: strings of 20 or more
    characters of an alphabet of 67, with a letter and a digit, but no slugs or paths of plain words; the
    span reaches from the first to the last hot window of 20.  A window is hot if it holds a letter and
    digits, touches no allowed word, and its entropy is that of its own character class or more.  Such a
    span is added unless it lies wholly within one pattern's span.  A null text has no spans; a text may
    be of any length, as each symbol of a candidate is handled once.  Other columns pass through, whatever
    their names; one named ``spans`` is replaced.  Each row is scanned by itself.
    """
    own = [c for c in docs.columns if c != spans_col]
    return _scan(_rows(docs, own, text_col)).select("row.*", F.col("spans").alias(spans_col))


def joined(spans: Column | str, base_only: bool = False) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    col = F.col(spans) if isinstance(spans, str) else spans
    names = F.array(*[F.lit(k) for k in KINDS])
    if base_only:
        col = F.filter(col, lambda s: s["kind"] < 3)
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of secrets in ``text`` replaced by ``mark``; spans that overlap by one mark.
    Texts without secrets, nulls included, stay as they are, as do all other columns."""
    df = _scan(_rows(docs, docs.columns, text_col))
    # Cut into blocks, as finding a place in a text takes as long as the place is far from its start.
    first, end = f"int(before div {BLOCK})", f"int((s.start - 1) div {BLOCK})"
    plain = (
        f"if({first} = {end}, substring(blocks[{first}], int(before % {BLOCK}) + 1, int(s.start - before)), concat(substring(blocks[{first}], int(before % {BLOCK}) + 1), "
        f"array_join(slice(blocks, {first} + 2, {end} - {first} - 1), ''), substring(blocks[{end}], 1, int((s.start - 1) % {BLOCK}) + 1)))"
    )
    piece = f"transform(found, (s, i) -> {_let('before', 'pre(i)', f'concat(if(s.start > before, {plain}, {_sql(str())}), if(i = 0 or s.start >= before, {_sql(mark)}, {_sql(str())}))')})"
    new = f"concat(array_join({_prefix('ends', 'max', piece)}, ''), substring(_text, int(array_max(ends)) + 1))"
    new = _let("blocks", f"regexp_extract_all(_text, '(?s).{{1,{BLOCK}}}', 0)", _let("found", "spans", _let("ends", "transform(found, s -> s.end)", new)))
    new = F.expr(f"if(size(spans) = 0, null, {new})")
    df = df.select("row", new.alias("_new"))
    return df.select(*[F.coalesce("_new", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
