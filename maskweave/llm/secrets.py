"""Secrets in texts: plain patterns, and credentials in several parts.

Plain patterns report on their own. Weak candidates (an account or client
identifier, a long random-looking string, an endpoint) are too common alone:
each is reported only where parts that complete it lie in the same scope, the
``SCOPE`` code points around it. Parts are linked by an interval join over the
sorted parts of a text: an identifier needs a secret, a secret an identifier,
an endpoint both. The join walks sorted lists and never forms pairs.

Cases: a null text counts as empty; whole texts are searched, whatever their
length; repeated rows are searched each; an empty table gives an empty result;
input columns other than the id and the text are not read.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from maskweave.llm.common import table


def _any_case(word: str) -> str:
    """Both cases of ASCII letters only: the ignore-case flag would add other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([_any_case("password"), _any_case("passwd"), _any_case("secret"), _any_case("token"), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # longest runs, so the length can be asked for at once
_ID_WORDS = ("access_key_id", "accesskeyid", "client_id", "clientid", "account_id", "accountid", "tenant_id", "username", "login")
IDENTIFIER = re.compile(rf"""(?:{"|".join(map(_any_case, _ID_WORDS))})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{{4,}}""")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
BASE = KINDS[:3]
SCOPE = 400

Span = tuple[int, int]


def _random_looking(s: str) -> bool:
    return any(map(str.isdigit, s)) and any(map(str.isupper, s)) and any(map(str.islower, s))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the plain patterns; leftmost and non-overlapping within a kind."""
    low = text.lower()
    found: dict[str, list[Span]] = {k: [] for k in BASE}
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    return found


def _within(span: Span, parts: list[Span], scope: int) -> bool:
    """Whether a part overlaps the span widened by ``scope``. Parts of a kind don't overlap, so both their ends ascend."""
    i = bisect_left(parts, span[0] - scope, key=lambda p: p[1])
    return i < len(parts) and parts[i][0] < span[1] + scope and (parts[i] != span or _within_next(span, parts, i, scope))


def _within_next(span: Span, parts: list[Span], i: int, scope: int) -> bool:
    return i + 1 < len(parts) and parts[i + 1][0] < span[1] + scope


def linked_spans(text: str, base: dict[str, list[Span]], scope: int = SCOPE) -> dict[str, list[Span]]:
    """Weak candidates that complementary parts complete."""
    low = text.lower()
    ids = [m.span() for m in IDENTIFIER.finditer(text)] if any(k in low for k in _ID_WORDS) else []
    identifiers = [ids, base["access"]]
    if not any(identifiers):
        return {}
    random = [m.span() for m in RANDOM.finditer(text) if _random_looking(m[0])]
    taken = [s for k in BASE for s in base[k]]
    random = [r for r in random if not any(a < r[1] and r[0] < b for a, b in taken)] if len(taken) < 64 else _clear(random, taken)
    secrets = [random, base["assign"], base["hex"]]
    near = lambda s, kinds: any(_within(s, parts, scope) for parts in kinds)
    out = {"identifier": [s for s in ids if near(s, secrets)], "random": [s for s in random if near(s, identifiers)]}
    if "://" in text and any(secrets):
        ends = [m.span() for m in ENDPOINT.finditer(text)]
        out["endpoint"] = [s for s in ends if near(s, identifiers) and near(s, secrets)]
    return out


def _clear(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that none of ``taken`` overlaps, by a merge of the two."""
    out, reach, i, taken = [], -1, 0, sorted(taken)
    for a, b in spans:
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= a:
            out.append((a, b))
    return out


def listed(found: dict[str, list[Span]]) -> str:
    order = sorted((a, KINDS.index(k), b) for k, spans in found.items() for a, b in spans)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in order)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: counts of the plain kinds, a digest of their spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                for out, x in zip(rows, [*(len(base[k]) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base | linked_spans(t, base, scope))]):
                    out.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=[id_col, *names])

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: places from what lies between matches, and the interval join as a join."""
    quote = lambda r: "'" + r.pattern.replace("(?<![A-Za-z0-9+/])", "").replace("'", "''") + "'"  # noqa: E731  a longest run needs no look back
    kinds = ", ".join(f"({i}, '{k}', {quote(r)})" for i, (k, r) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, RANDOM, ENDPOINT))))
    near = lambda ids: f"EXISTS (SELECT 1 FROM s AS o WHERE o.rid = s.rid AND o.k IN ({ids}) AND o.b >= s.a - {SCOPE} AND o.a < s.b + {SCOPE})"
    order = "string_agg(kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a, k, b)"
    return f"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT rid, k, kind, re, regexp_extract_all(t, re) AS ms, regexp_split_to_array(t, re) AS gs FROM t, (VALUES {kinds}) AS kinds(k, kind, re)
), i AS (
  SELECT rid, k, kind, re, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m
), f AS (
  SELECT rid, k, kind, re, ms[i] AS x, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS a FROM i
), g AS MATERIALIZED (
  SELECT rid, k, kind, x, a, a + length(x) AS b FROM f
  WHERE CASE k WHEN 0 THEN length(regexp_extract(x, re, 2)) >= 6 WHEN 1 THEN length(x) >= 20
             WHEN 4 THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') ELSE true END
), s AS MATERIALIZED (
  SELECT * FROM g WHERE k <> 4 OR NOT EXISTS (SELECT 1 FROM g AS o WHERE o.rid = g.rid AND o.k < 3 AND o.a < g.b AND g.a < o.b)
), l AS (
  SELECT rid, k, kind, a, b FROM s
  WHERE k < 3 OR (k = 3 AND {near('0, 2, 4')}) OR (k = 4 AND {near('1, 3')}) OR (k = 5 AND {near('1, 3')} AND {near('0, 2, 4')})
), c AS (
  SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         coalesce({order} FILTER (WHERE k < 3), '') AS base, {order} AS spans FROM l GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN c USING (rid)
"""


SQL = {"op4_secret_scan": _sql()}
QUERIES = {"op4_secret_scan": op4_secret_scan}
