"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

from fabula.llm import secrets
from fabula.llm.url_filter import INDEX_PAGES, TRACKING

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


def url_filters(rules, hosts, domains, langs, numbers: int) -> str:
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    index = "|".join(p.replace(".", r"\.") for p in INDEX_PAGES)
    return rf"""
WITH listed AS (SELECT h || '.' || d || '/' || l || '/' || n AS key FROM (SELECT unnest({list(hosts)}) AS h), (SELECT unnest({list(domains)}) AS d), (SELECT unnest({list(langs)}) AS l), range(0, {numbers}) t(n)),
p AS (SELECT page_id, contains(url, '://') AS is_url, coalesce({_LOWER.format(x="regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, list_sort([x FOR x IN string_split(query, '&') IF x <> '' AND NOT list_contains({list(TRACKING)}, split_part(x, '=', 1))]) AS args,
  regexp_replace(regexp_replace(host, '^[^@]*@|:(?:80|443)?$', '', 'g'), '^(?:www|m|blog)\.', '') || regexp_replace(regexp_replace(path, '/(?:{index})$', '/'), '\.html?$|/+$', '', 'g') AS base FROM p),
j AS (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled, CASE WHEN is_url THEN base || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key FROM k)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, ruled IS NULL AND l.key IS NOT NULL AS listed FROM j LEFT JOIN listed l ON l.key = j.key"""


CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
r AS (SELECT *, '<|im_start|>' || role || chr(10) || CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
  THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END || '<|im_end|>' || chr(10) AS rendered FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, rendered) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, rendered) FILTER (role = 'assistant'), '') AS loss, CAST(sum(length(rendered)) AS BIGINT) AS formatted_chars FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=_LOWER.format(x="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""


def quality(floor: int, percent: int, min_share: float, min_words: int) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(x="text")} AS w FROM d),
k AS (SELECT r, k, count(*) OVER (PARTITION BY r, array_to_string(w[k:k + 4], ' ')) > 1 AS again FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
c AS (SELECT r, count(DISTINCT k + j) AS n_repeat_words FROM k, range(0, 5) t(j) WHERE again GROUP BY 1),
l AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT r, doc_id, host, text, key, sum(n) AS n FROM (SELECT r, doc_id, host, text, len({_WORDS.format(x="line")}) AS n, array_to_string({_WORDS.format(x=_LOWER.format(x="line"))}, ' ') AS key FROM l) WHERE n > 0 GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT (doc_id, text)) AS of_host FROM d GROUP BY 1),
counted AS (SELECT host, key, count(DISTINCT (doc_id, text)) AS n FROM f GROUP BY 1, 2),
often AS (SELECT c.host, key FROM counted c JOIN hosts h ON h.host IS NOT DISTINCT FROM c.host WHERE n > {floor} AND 100 * n > {percent} * of_host),
lost AS (SELECT r, sum(n) AS lost FROM f JOIN often o ON o.key = f.key AND o.host IS NOT DISTINCT FROM f.host GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost FROM w LEFT JOIN c USING (r) LEFT JOIN b USING (r) LEFT JOIN lost USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - lost AS stays FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost AS n_boilerplate_words, NOT base_failed AND stays >= {min_words} AND stays >= {min_share} * n_words AS kept FROM j"""


def secret_scans() -> str:
    text = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    found = lambda kind, pattern, group: (
        f"SELECT r, {kind} AS kind, regexp_extract_all(text, {text(pattern)}) AS t, regexp_extract_all(text, {text(pattern)}, {group}) AS g, string_split_regex(text, {text(pattern)}) AS gap FROM d"
    )
    masked = f"regexp_replace(t, {text(secrets.UUID)}, repeat(' ', {secrets.UUID_CHARS}), 'g')"
    for word in secrets.ALLOWED_WORDS:
        masked = f"regexp_replace({masked}, '{word}', repeat(' ', {len(word)}), 'gi')"
    slug = f"list_bool_and([regexp_matches(x, '{secrets.PLAIN_PART}') FOR x IN string_split_regex(t, '{secrets.PART_CUT}')])"
    plain = lambda chars: f"translate(v, '{chars}', '') = ''"
    digits = "len(v) - len(translate(v, '0123456789', ''))"
    limit = "CASE " + " ".join(f"WHEN {plain(c)} THEN CASE WHEN {digits} >= {d} THEN {secrets.most_bits(b)} ELSE -1 END" for c, b, d in secrets.CLASSES) + " END"
    name = f"{list(secrets.KINDS)}[kind + 1]"
    said = f"{name} || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found(0, secrets.ASSIGN, 2)} UNION ALL {found(1, secrets.ACCESS, 0)} UNION ALL {found(2, secrets.HEX, 0)} UNION ALL {found(3, secrets.CANDIDATE, 0)}),
u AS (SELECT r, kind, unnest(t) AS t, unnest(g) AS g, unnest(gap[1:len(t)]) AS gap, unnest(range(1, len(t) + 1)) AS i FROM f),
m AS (SELECT r, kind, t, g, i, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS b FROM u),
base AS (SELECT r, kind, b - length(t) AS a, b FROM m WHERE (kind = 0 AND length(g) >= {secrets.ASSIGN_MIN}) OR (kind = 1 AND length(t) >= {secrets.ACCESS_MIN}) OR kind = 2),
c AS (SELECT r, i, {masked} AS t, b - length(t) AS a FROM m WHERE kind = 3 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') AND NOT {slug}),
v AS (SELECT r, i, a, k, {limit} AS most, v FROM (SELECT *, substr(t, k, {secrets.WINDOW}) AS v FROM (SELECT *, unnest(range(1, length(t) - {secrets.WINDOW - 2})) AS k FROM c))
  WHERE NOT contains(v, ' ') AND regexp_matches(v, '[A-Za-z]')),
w AS (SELECT r, i, a, most, k, unnest(string_split(v, '')) AS x FROM v),
e AS (SELECT r, i, a, most, k, sum(round(n * log2(n) * 1e6)) AS s FROM (SELECT r, i, a, most, k, x, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
h AS (SELECT r, 3 AS kind, a + min(k) - 1 AS a, a + max(k) - 1 + {secrets.WINDOW} AS b FROM e AS e WHERE s <= most GROUP BY r, i, e.a),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = h.r AND base.a <= h.a AND h.b <= base.b))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({said}, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY d.r, doc_id"""


_FIELD = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"({_FIELD.format(x=x)})" for x in fields) + ")"


#: CRC-32 by its table; the trees level by level; then each leaf folded with its siblings, one step at a time.
MERKLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("text")} AS leaf, {_leaf(_LOWER.format(x="text"))} AS lowered,
  coalesce(xor(list_reduce([4294967295] || [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, c: xor(a // 256, t[1 + xor(a, c) % 256])), 4294967295) % 3 = 0, false) AS hit FROM documents, crc),
l AS (SELECT r, doc_id, lang, leaf, CASE WHEN hit THEN lowered ELSE leaf END AS start, row_number() OVER g - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM d WINDOW g AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, hit AND lowered <> leaf, lowered)),
tree AS (SELECT 0 AS level, lang, i, n, leaf AS node FROM l UNION ALL
  SELECT level + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY level, lang, i // 8, n),
sub AS (SELECT lang, level, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, i, n, node FROM sub UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n),
root AS (SELECT node AS root FROM top WHERE n = 1),
own AS (SELECT r, level, l.i // CAST(pow(8, level) AS BIGINT) AS i, l.lang FROM l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) k ON k.lang IS NOT DISTINCT FROM l.lang),
low AS (SELECT r, o.level AS step, coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i < o.i), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i > o.i), '') AS after
  FROM own o JOIN tree t ON t.lang IS NOT DISTINCT FROM o.lang AND t.level = o.level AND t.i // 8 = o.i // 8 GROUP BY r, o.level),
high AS (SELECT s.lang, s.level + t.level AS step, coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i < s.i // CAST(pow(8, t.level) AS BIGINT)), '') AS before,
  coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i > s.i // CAST(pow(8, t.level) AS BIGINT)), '') AS after
  FROM sub s JOIN top t ON t.n > 1 AND t.i // 8 = s.i // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY s.lang, s.level, t.level),
steps AS (SELECT * FROM low UNION ALL SELECT r, step, before, after FROM l JOIN high h ON h.lang IS NOT DISTINCT FROM l.lang),
fold AS (SELECT r, 0 AS step, start AS h FROM l UNION ALL SELECT f.r, f.step + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.r = f.r AND s.step = f.step),
done AS (SELECT r, arg_max(h, step) AS folded_root FROM fold GROUP BY 1),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY step) AS p FROM steps GROUP BY 1)
SELECT doc_id, leaf, sub.node AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root JOIN done USING (r) LEFT JOIN proofs USING (r)"""
