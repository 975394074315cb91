"""URL rules, and a list of URLs behind a blocked Bloom filter.

A rule names a host and a path prefix; it fits the host, its subdomains and
paths that start with the prefix, and the longest fitting rule decides. Other
URLs are looked up in a list by their canonical form: a blocked Bloom filter of
the list passes what may be in it, and an exact hash join removes its false
positives, so the filter's size bounds memory and never changes a result.

The filter has 512-bit blocks, a bit in each of a block's eight words, and at
most ``MAX_BLOCKS`` blocks (16 MiB): its rows are few enough to broadcast
whatever the list's length. Beyond that it passes more, and the join does more.

Cases: a null URL or one without ``://`` has an empty host and path, fits no
rule and is in no list; repeated rows are judged each; an empty list or table is
fine; clashing column names of the input are replaced.
"""
from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import Positions, table
from maskweave.storage import compacted

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_BLOCKS = 1 << 18
BITS_PER_URL = 16
#: Columns of the result; they replace input columns of these names.
FOUND = ("host", "path", "listed", "rule", "verdict")
#: Odd multipliers, one for each word of a block.
SALTS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 63) | 1 for i in range(8))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Query parameters that don't change the page.
_TRACKING = r"^(utm_.*|ref|ref=.*)$"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, sorted
    query without tracking parameters; no scheme or fragment. Empty: not a URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.substring(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3), 2, 1 << 30)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)))
    path = F.regexp_replace(path_of(url), "/+$", "")
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host == "", "").otherwise(full)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> list[Column]:
    """A bit of each word, from the top six bits of the salted hash."""
    h = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(F.xxhash64(h, F.lit(s)), 58).cast("int") for s in SALTS]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(n_blocks))


def bloom(listed: DataFrame, key: str = "_url_key") -> tuple[DataFrame, int]:
    """Rows (_b, _w0 .. _w7) of the filter of ``listed``, and its number of blocks."""
    n = listed.count()
    n_blocks = 64
    while n_blocks < MAX_BLOCKS and n_blocks * 512 < n * BITS_PER_URL:
        n_blocks *= 2
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, b)).alias(f"_w{i}") for i, b in enumerate(_bits(F.col(key)))]
    return listed.groupBy(_block(F.col(key), n_blocks).alias("_b")).agg(*words), n_blocks


def may_be_listed(urls: DataFrame, filter_rows: DataFrame, n_blocks: int, key: str = "_url_key") -> DataFrame:
    """``urls`` with ``_maybe``. The filter's rows are at most MAX_BLOCKS, so they are broadcast."""
    one = F.lit(1).cast("long")
    hit = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(F.call_function("shiftleft", one, b)) != 0 for i, b in enumerate(_bits(F.col(key)))])
    out = urls.withColumn("_block", _block(F.col(key), n_blocks)).join(F.broadcast(filter_rows), F.col("_block") == F.col("_b"), "left")
    return out.withColumn("_maybe", F.coalesce(hit, F.lit(False)) & (F.col(key) != "")).drop("_block", "_b", *[f"_w{i}" for i in range(8)])


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict. ``listed`` has one column of URLs."""
    keys = compacted(listed.select(canonical(F.col(listed.columns[0])).alias("_url_key")).where("_url_key <> ''").distinct(), "listed")
    filter_rows, n_blocks = bloom(keys)
    held = Positions(pages)
    url = F.col(held[url])
    seen = held.rows.withColumns({"host": host_of(url), "path": path_of(url), "_url_key": canonical(url)})
    seen = may_be_listed(seen, filter_rows, n_blocks)
    passed = seen.where(~F.col("_maybe")).withColumn("listed", F.lit(False))
    exact = keys.withColumn("listed", F.lit(True))
    hits = seen.where("_maybe").join(exact, "_url_key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    out = passed.unionByName(hits).withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})
    kept = [(n, i) for n, i in zip(held.names, held.inner) if n.lower() not in FOUND]
    return out.select(*[i for _, i in kept], *FOUND).toDF(*[n for n, _ in kept], *FOUND)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged; the list holds the URLs of pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 100 = 0").select("url")
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = {
    "op6_url_filter": rf"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path,
         substr(regexp_extract(coalesce(url, ''), '{_PARTS}', 3), 2) AS query
  FROM pages
), k AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}'))) AS ps FROM u
), c AS (
  SELECT *, CASE WHEN h = '' THEN '' ELSE h || regexp_replace(path, '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS url_key
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') AS h FROM k)
), l AS (
  SELECT DISTINCT url_key FROM c WHERE page_id % 100 = 0 AND url_key <> ''
), r AS (
  SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(what, length(rh || rp)) AS what
  FROM c, (VALUES {_SQL_RULES}) AS rules(what, rh, rp)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid
)
SELECT page_id, host, path, rule, l.url_key IS NOT NULL AS listed,
       coalesce(what, CASE WHEN l.url_key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN r USING (rid) LEFT JOIN l USING (url_key)
""",
}
QUERIES = {"op6_url_filter": op6_url_filter}
