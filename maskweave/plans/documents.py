"""Queries over documents: stateless redaction, detection and counts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import CHUNK_OVERLAP, PII_CATEGORIES, PII_TYPES
from maskweave.functions import spans as S
from maskweave.functions.core import sql_string
from maskweave.operators import rules, stateless
from maskweave.operators.chunks import owned_chunks

EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
MULTI = {
    "phone": r"\+?[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "token": r"token = \"[^\"]+\"",
}
CASED = ("the", "onen", "er")
UNCASED = ("The", "AND", "de la")


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _redacted(spark: SparkSession, sf_dir: str, patterns: list[str]) -> DataFrame:
    out = docs(spark, sf_dir, "doc_id", "text").withColumn("r", stateless.redact_patterns(F.col("text"), patterns))
    return out.select("doc_id", F.col("r.text").alias("redacted_text"), F.size("r.pairs").cast("long").alias("n_labels"))


def regex_redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [EMAIL])


def regex_redact_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, list(MULTI.values()))


def _sql_redact(patterns: list[str]) -> str:
    found = "list_concat(" * (len(patterns) - 1) + f"regexp_extract_all(text, '(?i){patterns[0]}')" + "".join(f", regexp_extract_all(text, '(?i){p}'))" for p in patterns[1:])
    return f"""
WITH m AS (
  SELECT doc_id, text, list_sort(list_transform(list_distinct(list_filter({found}, lambda x: x <> '')), lambda x: {{'n': -length(x), 'o': x}})) AS ms FROM documents
), p AS (
  SELECT doc_id, text, list_transform(range(1, len(ms) + 1), lambda i: {{'o': ms[i].o, 'l': '<<REDACTED_REGEX_' || CAST(i - 1 AS VARCHAR) || '>>'}}) AS ps FROM m
)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_labels,
       list_reduce(list_concat([{{'o': text, 'l': ''}}], ps), lambda a, x: {{'o': replace(a.o, x.o, x.l), 'l': ''}}).o AS redacted_text
FROM p
"""


def regex_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by language and pattern; every pair has a row."""
    d = docs(spark, sf_dir, "lang", "text")
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in MULTI.items()]
    per = d.select("lang", *counts).groupBy("lang").agg(*[F.sum(n).alias(n) for n in MULTI])
    return per.unpivot("lang", list(MULTI), "pattern", "n_matches")


def keyword_redact_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stateless.usable_keywords([stateless.Keyword(k) for k in CASED])
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", stateless.redact_keywords(F.col("text"), words, protect=False).alias("redacted_text"))


def keyword_redact_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stateless.usable_keywords([stateless.Keyword(k, case_sensitive=False) for k in UNCASED])
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", stateless.redact_keywords(F.col("text"), words).alias("redacted_text"))


def keyword_label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's label and the documents that hold it: labels exist for all, hits for some."""
    words = stateless.usable_keywords([stateless.Keyword(k) for k in CASED])
    d = docs(spark, sf_dir, "text")
    hits = d.agg(*[F.sum(F.contains("text", F.lit(t)).cast("long")).alias(f"k{i}") for i, (t, _) in enumerate(words)])
    rows = hits.select(F.explode(F.array(*[F.struct(F.lit(t).alias("keyword"), F.lit(f"<<REDACTED_KEYWORD_{i}>>").alias("label"), F.col(f"k{i}").alias("n_docs")) for i, (t, _) in enumerate(words)])).alias("r"))
    return rows.select("r.*")


def rule_detect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail spans with their places."""
    d = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(rules.candidates(F.col("text"), ("private_email",))).alias("s"))
    return d.select("doc_id", "s.type", F.col("s.text").alias("matched"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "doc_id", "source", "text").withColumn("spans", rules.detect(F.col("text")))


def rule_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds, merged and held against the threshold."""
    d = _detected(spark, sf_dir).select("doc_id", F.explode("spans").alias("s"))
    return d.select("doc_id", "s.type", F.col("s.text").alias("matched"), F.col("s.start").cast("long").alias("start_at"))


def span_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans of each document's start, merged: spans (0, n) and (k, k + n) from its length."""
    n = (F.col("n_chars") % 7 + 2).cast("int")
    k = (F.col("n_chars") % 5).cast("int")
    of = lambda a, b, c: F.struct(F.lit("secret").alias("type"), F.lit("").alias("text"), a.alias("start"), b.alias("end"), F.lit(c).cast("float").alias("confidence"))
    spans = F.array(of(F.lit(0), n, 0.95), of(k, k + n + 1, 0.5), of(k + n, k + 2 * n, 0.99))
    d = docs(spark, sf_dir, "doc_id", "n_chars").withColumn("m", S.merge_overlaps(spans))
    return d.select("doc_id", F.size("m").cast("long").alias("n_kept"), F.element_at("m", 1)["end"].cast("long").alias("first_end"), F.size(S.confident(F.col("m"), 0.9)).cast("long").alias("n_confident"))


def span_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spans for each document, by type and by whether they lie within the text."""
    n = F.col("n_chars").cast("int")
    of = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), F.lit("").alias("text"), a.alias("start"), b.alias("end"), F.lit(1.0).cast("float").alias("confidence"))
    spans = F.array(of("secret", F.lit(0), n), of("private_email", F.lit(1), F.lit(3)), of("private_url", n - 1, n + 1), of("private_date", F.lit(50), F.lit(60)))
    wanted = S.of_types(spans, ["secret", "private_url", "private_date"])
    d = docs(spark, sf_dir, "doc_id", "n_chars")
    return d.select("doc_id", F.size(wanted).cast("long").alias("n_wanted"), F.array_join(F.transform(S.valid(wanted, n), lambda s: s["type"]), ",").alias("valid"))


def span_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all kinds, and those above a threshold: the weak rules fall to it."""
    spans = F.col("spans")
    d = docs(spark, sf_dir, "doc_id", "text").withColumn("spans", rules.candidates(F.col("text")))
    return d.select("doc_id", F.size(spans).cast("long").alias("n_all"), F.size(S.confident(spans, 0.95)).cast("long").alias("n_confident"))


def redact_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir, "doc_id", "text").withColumn("spans", rules.detect(F.col("text")))
    return d.select("doc_id", S.redact_placeholders(F.col("text"), F.col("spans")).alias("redacted_text"))


def pii_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of all kinds that rules tell, over all documents. What two patterns of one kind find at one place counts once."""
    kinds = dict.fromkeys(k for k, _, _ in rules.RULES)
    d = docs(spark, sf_dir, "text").select(F.explode(F.flatten(F.array(*[S.merge_overlaps(rules.candidates(F.col("text"), (k,))) for k in kinds]))).alias("s"))
    return d.groupBy(F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def pii_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by category, with subtotals."""
    per = pii_type_breakdown(spark, sf_dir).join(F.broadcast(rules.categories(spark)), "type")
    return per.rollup("category", "type").agg(F.sum("n").alias("n"))


def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found in each document, in words."""
    d = docs(spark, sf_dir, "doc_id", "text").withColumn("spans", rules.detect(F.col("text")))
    return d.select("doc_id", S.summary(F.col("spans")).alias("summary"), F.array_join(S.describe(F.col("spans")), "; ").alias("entities"))


def token_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 1,000 tokens with 128 shared, over n_chars taken as token counts."""
    d = docs(spark, sf_dir, "doc_id", "n_chars").withColumn("c", F.explode(owned_chunks(F.col("n_chars"), 1000, CHUNK_OVERLAP)))
    return d.select("doc_id", "c.chunk", "c.start_at", "c.end_at", "c.owned_end")


_E = next(p for k, p, _ in rules.RULES if k == "private_email")


def spans_sql(types: tuple[str, ...] = PII_TYPES) -> str:
    """All spans of the rules of some types by document: place, end, rule, kind, text and confidence (32 bits), in the order of the merge."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS r, '{k}' AS ty, CAST({c} AS FLOAT) AS c, regexp_extract_all(text, {sql_string(p)}) AS ms, regexp_split_to_array(text, {sql_string(p)}) AS gs FROM documents" for i, (k, p, c) in enumerate(rules.RULES) if k in types
    )
    return f"""WITH g AS ({found}), i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM g),
p AS (SELECT doc_id, r, ty, c, ms[i] AS t, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i),
s AS (SELECT doc_id, {{'a': a, 'nb': -(a + length(t)), 'r': r, 'b': a + length(t), 'ty': ty, 't': t, 'c': c}} AS x FROM p)"""


def _merged(spans: str) -> str:
    """The merge over a sorted list of spans, one after another."""
    meets = "coalesce(list_position(list_transform(acc, lambda k: x[1].a < k.b AND x[1].b > k.a), true), 0)"
    return f"""list_reduce(list_transform({spans}, lambda s: [s]), lambda acc, x: CASE WHEN {meets} = 0 THEN list_concat(acc, x)
      ELSE list_transform(acc, lambda k, i: CASE WHEN i = {meets} AND x[1].b - x[1].a > k.b - k.a THEN x[1] ELSE k END) END)"""


def found_sql(types: tuple[str, ...] = PII_TYPES, threshold: float = 0.9) -> str:
    """``f`` (doc_id, text, ss): the spans of each document, merged and held against the threshold."""
    return spans_sql(types) + f""", m AS (SELECT doc_id, {_merged("list(x ORDER BY x.a, x.nb, x.r)")} AS m FROM s GROUP BY doc_id),
f AS (SELECT d.doc_id, text, list_filter(coalesce(m, []), lambda k: k.c >= CAST({threshold} AS FLOAT)) AS ss FROM documents AS d LEFT JOIN m USING (doc_id))"""


_SPANS, _FOUND = spans_sql(), found_sql()
_BREAKDOWN = _SPANS + f", m AS (SELECT x.ty AS ty, {_merged('list(x ORDER BY x.a, x.nb, x.r)')} AS m FROM s GROUP BY doc_id, x.ty), n AS (SELECT ty AS type, CAST(sum(len(m)) AS BIGINT) AS n FROM m GROUP BY ty)"
_CATEGORIES = ", ".join(f"('{c}', '{t}')" for c, ts in PII_CATEGORIES.items() for t in ts)
_CASED = sorted(CASED, key=lambda k: -len(k))
_UNCASED = sorted(UNCASED, key=lambda k: -len(k))


def _nested(text: str, words: list[str], ci: bool) -> str:
    for i, w in enumerate(words):
        text = f"regexp_replace({text}, '{w}', '<<REDACTED_KEYWORD_{i}>>', 'gi')" if ci else f"replace({text}, '{w}', '<<REDACTED_KEYWORD_{i}>>')"
    return text


SQL = {
    "regex_redact_email": _sql_redact([EMAIL]),
    "regex_redact_multi": _sql_redact(list(MULTI.values())),
    "regex_match_counts": "SELECT lang, pattern, CAST(sum(n) AS BIGINT) AS n_matches FROM (" + " UNION ALL ".join(f"SELECT lang, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for n, p in MULTI.items()) + ") GROUP BY ALL",
    "keyword_redact_cs": f"SELECT doc_id, {_nested('text', _CASED, False)} AS redacted_text FROM documents",
    "keyword_redact_ci": f"SELECT doc_id, {_nested('text', _UNCASED, True)} AS redacted_text FROM documents",
    "keyword_label_dictionary": " UNION ALL ".join(f"SELECT '{w}' AS keyword, '<<REDACTED_KEYWORD_{i}>>' AS label, count(*) FILTER (WHERE contains(text, '{w}')) AS n_docs FROM documents" for i, w in enumerate(_CASED)),
    "rule_detect_spans": f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{_E}') AS ms, regexp_split_to_array(text, '{_E}') AS gs FROM documents),
s AS (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM p),
q AS (SELECT doc_id, ms[i] AS matched, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_at FROM s)
SELECT doc_id, 'private_email' AS type, matched, start_at, start_at + length(matched) AS end_at FROM q
""",
    "rule_detect_all": _FOUND + " SELECT doc_id, k.ty AS type, k.t AS matched, k.a AS start_at FROM (SELECT doc_id, unnest(ss) AS k FROM f)",
    "span_overlap_merge": f"""
WITH d AS (SELECT doc_id, n_chars % 7 + 2 AS n, n_chars % 5 AS k FROM documents),
s AS (SELECT doc_id, list_sort([{{'a': 0, 'nb': -n, 'r': 0, 'b': n, 'c': CAST(0.95 AS FLOAT)}}, {{'a': k, 'nb': -(k + n + 1), 'r': 1, 'b': k + n + 1, 'c': CAST(0.5 AS FLOAT)}}, {{'a': k + n, 'nb': -(k + 2 * n), 'r': 2, 'b': k + 2 * n, 'c': CAST(0.99 AS FLOAT)}}]) AS ss FROM d),
m AS (SELECT doc_id, {_merged("ss")} AS m FROM s)
SELECT doc_id, CAST(len(m) AS BIGINT) AS n_kept, CAST(m[1].b AS BIGINT) AS first_end, CAST(len(list_filter(m, lambda k: k.c >= CAST(0.9 AS FLOAT))) AS BIGINT) AS n_confident FROM m
""",
    "span_validity": """
SELECT doc_id, CAST(3 AS BIGINT) AS n_wanted, CASE WHEN n_chars > 0 THEN 'secret' ELSE '' END || CASE WHEN n_chars >= 60 THEN ',private_date' ELSE '' END AS valid FROM documents""",
    "span_threshold_filter": _SPANS + ", n AS (SELECT doc_id, count(*) AS a, count(*) FILTER (WHERE x.c >= CAST(0.95 AS FLOAT)) AS b FROM s GROUP BY doc_id) SELECT doc_id, coalesce(a, 0) AS n_all, coalesce(b, 0) AS n_confident FROM documents LEFT JOIN n USING (doc_id)",
    "redact_placeholder": _FOUND + """
SELECT doc_id, list_reduce(list_concat([{'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 't': text}], list_transform(list_reverse_sort(ss), lambda k: {'a': k.a, 'b': k.b, 't': '[REDACTED ' || replace(upper(k.ty), '_', ' ') || ']'})),
  lambda acc, x: {'a': x.a, 'b': x.b, 't': substr(acc.t, 1, x.a) || x.t || substr(acc.t, x.b + 1)}).t AS redacted_text FROM f""",
    "pii_type_breakdown": _BREAKDOWN + " SELECT type, n FROM n",
    "pii_category_rollup": _BREAKDOWN + f" SELECT category, type, CAST(sum(n) AS BIGINT) AS n FROM n JOIN (VALUES {_CATEGORIES}) AS c(category, type) USING (type) GROUP BY ROLLUP (category, type)",
    "entity_summary": _FOUND + """
SELECT doc_id, CASE len(ss) WHEN 0 THEN 'No sensitive data found' WHEN 1 THEN '1 item redacted' ELSE CAST(len(ss) AS VARCHAR) || ' items redacted' END AS summary,
       array_to_string(list_transform(ss, lambda k: k.ty || ': ' || k.t), '; ') AS entities FROM f""",
    "token_chunk_ranges": f"""
WITH c AS (SELECT doc_id, n_chars, unnest(range(0, greatest(1, CAST(ceil(greatest(n_chars - {CHUNK_OVERLAP}, 1) / {1000 - CHUNK_OVERLAP}.0) AS BIGINT)))) AS chunk FROM documents WHERE n_chars > 0)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(chunk * {1000 - CHUNK_OVERLAP} AS BIGINT) AS start_at, CAST(least(n_chars, chunk * {1000 - CHUNK_OVERLAP} + 1000) AS BIGINT) AS end_at,
       CASE WHEN chunk * {1000 - CHUNK_OVERLAP} + 1000 >= n_chars THEN n_chars ELSE (chunk + 1) * {1000 - CHUNK_OVERLAP} END AS owned_end
FROM c
""",
}
QUERIES = {f.__name__: f for f in (regex_redact_email, regex_redact_multi, regex_match_counts, keyword_redact_cs, keyword_redact_ci, keyword_label_dictionary, rule_detect_spans, rule_detect_all, span_overlap_merge, span_validity, span_threshold_filter, redact_placeholder, pii_type_breakdown, pii_category_rollup, entity_summary, token_chunk_ranges)}
