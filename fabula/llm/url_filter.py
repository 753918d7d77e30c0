"""URL verdicts: host and path rules, then a list of URLs behind a blocked Bloom filter.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.shared import written

#: A block has eight words of 64 bits; a key sets one bit in each.
WORDS = 8
#: The filter has at most so many blocks of 64 bytes: 16 MB, so that it can always be broadcast.
MAX_BLOCKS = 1 << 18
#: Bits of filter for each listed URL, up to that size.
BITS_PER_KEY = 16
#: Rules must be few, as each becomes an expression.
MAX_RULES = 1000
#: Keys over which URLs that are done are spread.
SPREAD = 1 << 16

Rule = tuple[str, str, str]  # verdict, host, path

# Index pages and query parameters that do not change what a URL shows.
INDEX_PAGES = ("index.html", "index.htm", "index.php")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """What a list names: host without user, default port and ``www.``, ``m.`` or ``blog.``; path without
    index page, ``.html`` and closing slash; query without tracking parameters; no scheme, no fragment.
    Null where the URL is null or has no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@|:(?:80|443)?$", ""), r"^(?:www|m|blog)\.", "")
    index = "|".join(p.replace(".", r"\.") for p in INDEX_PAGES)
    path = F.regexp_replace(F.regexp_replace(path_of(url), rf"/(?:{index})$", "/"), r"\.html?$|/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, query))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """One bit of a 64-bit word, chosen by six bits of a second hash."""
    spread = F.xxhash64(F.lit(word // 4), key)
    place = F.pmod(F.shiftright(spread, 6 * (word % 4)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks with a bit set: block, w0 ... w7.  ``listed`` has the column key."""
    words = [F.bit_or(_bit(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)]
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def judged(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """Judge each row of ``pages``: page_id, host, path, rule, verdict, listed.

    The longest rule (host and path together) that fits a URL decides; with two of one length, the one
    given first.  Where none fits, a URL is blocked if its canonical form is that of a URL in ``listed``,
    else allowed.  ``listed`` is true only for such hits.

    The filter of the list is broadcast, never over 16 MB.  URLs that it rules out are done; the others
    meet the list itself, each different one once, which removes false positives whatever their number.
    The pages are read twice: once for the URLs that pass the filter, once for the verdicts.
    A null URL, or one without ``://``, has an empty host and path, no rule, and is allowed.  Rows that
    repeat are judged alike; an empty list blocks nothing; other columns are not carried.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = _fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r[1] + r[2])).otherwise(rule), F.when(fits, F.lit(r[0])).otherwise(verdict)
    rows = rows.select("page_id", "host", "path", "key", rule.alias("rule"), verdict.alias("ruled"))

    keys = listed.select(canonical(F.col(list_col)).alias("key")).filter("key is not null").distinct()
    keys = written(keys, "listed")
    blocks = max(64, min(MAX_BLOCKS, keys.count() * BITS_PER_KEY // (64 * WORDS) + 1))
    bloom = bloom_filter(keys, blocks)
    all_set = F.lit(True)
    for w in range(WORDS):
        bit = _bit(F.col("key"), w)
        all_set = all_set & (F.col(f"w{w}").bitwiseAND(bit) == bit)
    # Only URLs without a rule need the list.
    probe = F.when(F.col("ruled").isNull(), _block(F.col("key"), blocks))
    passed = rows.withColumn("probe", probe).join(F.broadcast(bloom), F.col("probe") == F.col("block"), "left")
    passed = passed.withColumn("possible", F.coalesce(F.col("probe").isNotNull() & F.col("block").isNotNull() & all_set, F.lit(False)))
    passed = passed.select("page_id", "host", "path", "rule", "ruled", "key", "possible")

    # URLs that the filter rules out have no key to join by.  They are nearly all: each has one of many keys that meet nothing, so that
    # they spread over all tasks where the join is a shuffle.
    asked = passed.filter("possible").select("key", "possible").distinct()
    hits = asked.join(keys.hint("shuffle_hash"), "key", "left_semi").withColumn("listed", F.lit(True))
    spread = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SPREAD)).cast("string")
    passed = passed.withColumn("key", F.when(F.col("possible"), F.col("key")).otherwise(spread))
    out = passed.join(hits, ["key", "possible"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "listed")
