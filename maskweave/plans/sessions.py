"""Queries over sessions: a document's source is its session, its id the order."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import LABEL_PATTERN
from maskweave.functions.core import sql_string
from maskweave.functions.labels import replace_literals
from maskweave.operators import report, rules, session, stateless
from maskweave.plans.documents import found_sql

WORDS = r"th[a-f]+ing|Er[a-d]+sh"
KEYWORDS = (("thble", False), ("blere", True))
TYPES = ("private_email", "account_number", "private_phone", "secret")
_EMAIL = next(p for k, p, _ in rules.RULES if k == "private_email")
_CARD = next(p for k, p, _ in rules.RULES if k == "account_number")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), "text")


def _all(spark: SparkSession, sf_dir: str):
    return session.redact_sessions(fragments(spark, sf_dir), rules.detect(F.col("text"), TYPES), [WORDS], list(KEYWORDS))


def _plain(spark: SparkSession, sf_dir: str):
    return session.redact_sessions(fragments(spark, sf_dir), None, [_EMAIL, _CARD], None)


def _plain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.session_labels(fragments(spark, sf_dir), None, [_EMAIL, _CARD])


def session_label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of pattern matches in order of first appearance."""
    return _plain_labels(spark, sf_dir).select("session", "original", "label", F.col("first_seq").alias("first_doc"))


def pii_label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of spans: from the right within the fragment where they first appear."""
    texts = session.first_texts(fragments(spark, sf_dir)).withColumn("spans", rules.candidates(F.col("text"), ("private_email",)))
    return session.pii_dictionary(texts).select("session", "original", "n", F.col("first_seq").alias("first_doc"))


def session_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, with forward propagation."""
    return _all(spark, sf_dir)[0].select(F.col("seq").alias("doc_id"), "redacted_text")


def session_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all classes of each session, with what they stand for."""
    labels = session.session_labels(fragments(spark, sf_dir), rules.detect(F.col("text"), TYPES), [WORDS], list(KEYWORDS))
    return labels.select("session", "kind", "original", "label", F.col("first_seq").alias("first_doc"))


#: A profile with a pattern that doesn't compile, one that is off, a blank one, and keywords to trim and to leave out.
PROFILE = {
    "use_openai_model": True, "enabled_pii_types": ["private_email", "private_phone"], "pii_confidence_threshold": 0.95,
    "regex_patterns": [{"pattern": "("}, {"pattern": WORDS}, {"pattern": " "}, {"pattern": "[a-z]+", "enabled": False}],
    "keywords": [{"text": " blere\t", "case_sensitive": False}, {"text": "thble"}, {"text": "the", "enabled": False}, {"text": " "}],
}


def profile_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents redacted by a profile's switches."""
    return session.redact_for_profile(fragments(spark, sf_dir), PROFILE)[0].select(F.col("seq").alias("doc_id"), "redacted_text")


def forward_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold originals that their session has met by then, and the texts with their labels."""
    texts = session.first_texts(fragments(spark, sf_dir))
    dictionary = session.regex_dictionary(texts.withColumn("matches", stateless.matches(F.col("text"), [_EMAIL, _CARD])))
    known = session.known_originals(texts, dictionary, "text")
    pairs = session.longest_pairs(F.col("known"))
    return known.select("session", "text", F.size("known").cast("long").alias("n_known"), F.array_join(F.transform(pairs, lambda p: p["original"]), "\n").alias("originals"), replace_literals(F.col("text"), pairs).alias("redacted_text"))


def fragment_cache_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the first of its session with the same text."""
    f = fragments(spark, sf_dir)
    return f.join(session.first_texts(f), ["session", "text"]).select(F.col("seq").alias("doc_id"), "session", F.col("first_seq").alias("first_doc"))


def unredact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted and restored: the texts as they were."""
    out, dictionary = session.redact_sessions(fragments(spark, sf_dir), rules.detect(F.col("text"), TYPES), [WORDS], [(k, False) for k, _ in KEYWORDS], digest="_id")
    return session.restore_sessions(out.drop("text"), dictionary, by="_id").select(F.col("seq").alias("doc_id"), "restored_text")


def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and distinct labels of each profile (source)."""
    return session.profile_counts(_plain(spark, sf_dir)[0]).select(F.col("session").alias("profile"), "n_requests", F.col("n_labels").alias("n_regex"))


def request_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels by request and class."""
    return session.request_counts(_all(spark, sf_dir)[0], ["session", "seq"]).select("session", F.col("seq").alias("doc_id"), "kind", "n_labels")


def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and labels of all classes for each profile (source)."""
    out, _ = session.redact_sessions(fragments(spark, sf_dir), rules.candidates(F.col("text"), ("private_email",)), [_CARD], list(KEYWORDS))
    return session.profile_totals(out, len(KEYWORDS)).withColumnRenamed("session", "profile")


def match_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each session by label text, with the kind of what they stand for."""
    found = fragments(spark, sf_dir).select(F.explode(rules.candidates(F.col("text"), ("private_email",))).alias("s")).select(F.col("s.text").alias("original"), "s.type")
    return report.match_listing(_plain_labels(spark, sf_dir), found, "unknown").select("session", "label", "original", "type", "place")


_F = """
WITH f AS (SELECT source AS session, text, min(doc_id) AS first_seq FROM documents GROUP BY ALL),
m AS (SELECT session, first_seq, text, list_distinct(list_concat(regexp_extract_all(text, {email}), regexp_extract_all(text, {card}))) AS ms FROM f),
d AS (SELECT session, original, min(first_seq) AS first_doc FROM (SELECT session, first_seq, unnest(ms) AS original FROM m) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_doc, -length(original), original) - 1 AS n FROM d)
""".format(email=sql_string("(?i)" + _EMAIL), card=sql_string("(?i)" + _CARD))


def _in_turn(text: str, pairs: str) -> str:
    """A text with the originals of a list of (o, l) replaced one after another."""
    return f"list_reduce(list_prepend({{'o': '', 'l': {text}}}, {pairs}), lambda x, y: {{'o': '', 'l': replace(x.l, y.o, y.l)}}).l"


_PAIRS = "coalesce(list({'o': original, 'l': label} ORDER BY length(original) DESC, original), [])"
_BETWEEN = sql_string(LABEL_PATTERN)


def _whole(types: tuple[str, ...], keywords: tuple[tuple[str, bool], ...], threshold: float = 0.9) -> str:
    """``z``: each text of a session once, through all stages: spans from the right, patterns, keywords, what the session knows by then."""
    replaced = "body"
    for i, (word, ci) in enumerate(keywords):
        replaced = f"regexp_replace({replaced}, '{word}', '<<REDACTED_KEYWORD_{i}>>', 'gi')" if ci else f"replace({replaced}, '{word}', '<<REDACTED_KEYWORD_{i}>>')"
    return found_sql(types, threshold) + f""",
t0 AS (SELECT source AS session, d.text, min(d.doc_id) AS first_seq FROM documents AS d GROUP BY ALL),
t1 AS (SELECT t0.session, t0.text, first_seq, ss FROM t0 JOIN f ON first_seq = doc_id),
e1 AS (SELECT session, text, first_seq, unnest(ss) AS k FROM t1),
d1 AS (SELECT session, k.t AS original, min({{'s': first_seq, 'a': -k.a}}) AS x FROM e1 GROUP BY ALL),
n1 AS (SELECT session, original, x.s AS seen, '<<REDACTED_PII_' || CAST(row_number() OVER (PARTITION BY session ORDER BY x, original) - 1 AS VARCHAR) || '>>' AS label FROM d1),
c1 AS (SELECT e1.session, e1.text, list({{'a': k.a, 'b': k.b, 'l': label}} ORDER BY k.a DESC) AS cs FROM e1 JOIN n1 ON e1.session = n1.session AND k.t = original GROUP BY e1.session, e1.text),
t2 AS (SELECT session, text, first_seq, list_reduce(list_prepend({{'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'l': text}}, coalesce(cs, [])),
  lambda x, y: {{'a': y.a, 'b': y.b, 'l': substr(x.l, 1, y.a) || y.l || substr(x.l, y.b + 1)}}).l AS body FROM t1 LEFT JOIN c1 USING (session, text)),
m2 AS (SELECT *, list_distinct(flatten(list_transform(string_split_regex(body, {_BETWEEN}), lambda x: regexp_extract_all(x, {sql_string("(?i)" + WORDS)})))) AS ms FROM t2),
e2 AS (SELECT session, text, first_seq, unnest(ms) AS original FROM m2),
d2 AS (SELECT session, original, min(first_seq) AS seen FROM e2 GROUP BY ALL),
n2 AS (SELECT session, original, seen, '<<REDACTED_REGEX_' || CAST(row_number() OVER (PARTITION BY session ORDER BY seen, -length(original), original) - 1 AS VARCHAR) || '>>' AS label FROM d2),
c2 AS (SELECT e2.session, e2.text, {_PAIRS.replace("original", "e2.original")} AS ps FROM e2 JOIN n2 ON e2.session = n2.session AND e2.original = n2.original GROUP BY e2.session, e2.text),
t3 AS (SELECT session, text, first_seq, {_in_turn("body", "coalesce(ps, [])")} AS body FROM t2 LEFT JOIN c2 USING (session, text)),
t4 AS (SELECT session, text, first_seq, {replaced} AS body FROM t3),
n3 AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2),
c4 AS (SELECT t4.session, t4.text, {_PAIRS} AS ps FROM t4 JOIN n3 ON t4.session = n3.session AND seen <= first_seq AND contains(body, original) GROUP BY t4.session, t4.text),
z AS (SELECT session, text, {_in_turn("body", "coalesce(ps, [])")} AS redacted_text FROM t4 LEFT JOIN c4 USING (session, text))
"""


_WHOLE = _whole(TYPES, KEYWORDS)
SQL = {
    "session_redact": _WHOLE + "SELECT d.doc_id, redacted_text FROM documents AS d JOIN z ON d.source = z.session AND d.text = z.text",
    "profile_redact": _whole(("private_email", "private_phone"), (("blere", True), ("thble", False)), 0.95) + "SELECT d.doc_id, redacted_text FROM documents AS d JOIN z ON d.source = z.session AND d.text = z.text",
    "session_dictionary": _WHOLE + """SELECT session, 'PII' AS kind, original, label, seen AS first_doc FROM n1 UNION ALL SELECT session, 'REGEX', original, label, seen FROM n2
UNION ALL SELECT session, 'KEYWORD', unnest(['""" + "', '".join(k for k, _ in KEYWORDS) + """']), unnest(['<<REDACTED_KEYWORD_0>>', '<<REDACTED_KEYWORD_1>>']), NULL FROM (SELECT DISTINCT source AS session FROM documents)""",
    "request_label_counts": _WHOLE + f""", l AS (SELECT session, text, unnest(list_distinct(regexp_extract_all(redacted_text, {_BETWEEN}))) AS label FROM z)
SELECT d.source AS session, d.doc_id, regexp_extract(label, '_([A-Z]+)_', 1) AS kind, count(*) AS n_labels FROM documents AS d JOIN l ON d.source = l.session AND d.text = l.text GROUP BY ALL""",
    "session_label_numbering": _F + "SELECT session, original, '<<REDACTED_REGEX_' || CAST(n AS VARCHAR) || '>>' AS label, first_doc FROM n",
    "pii_label_numbering": f"""
WITH f AS (SELECT source AS session, text, min(doc_id) AS first_seq FROM documents GROUP BY ALL),
p AS (SELECT session, first_seq, regexp_extract_all(text, {sql_string(_EMAIL)}) AS ms, regexp_split_to_array(text, {sql_string(_EMAIL)}) AS gs FROM f),
s AS (SELECT session, first_seq, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM p),
q AS (SELECT session, first_seq, ms[i] AS original, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS place FROM s),
d AS (SELECT session, original, min({{'s': first_seq, 'a': -place}}) AS x FROM q GROUP BY ALL)
SELECT session, original, row_number() OVER (PARTITION BY session ORDER BY x, original) - 1 AS n, x.s AS first_doc FROM d
""",
    "forward_propagation": _F + """, k AS (
  SELECT m.session, m.text, list({'o': n.original, 'l': '<<REDACTED_REGEX_' || CAST(n AS VARCHAR) || '>>'} ORDER BY length(n.original) DESC, n.original) AS ps
  FROM m JOIN n ON m.session = n.session AND n.first_doc <= m.first_seq AND contains(m.text, n.original) GROUP BY m.session, m.text
)
SELECT session, text, len(ps) AS n_known, array_to_string(list_transform(ps, lambda p: p.o), chr(10)) AS originals,
       list_reduce(list_prepend({'o': '', 'l': text}, ps), lambda a, p: {'o': '', 'l': replace(a.l, p.o, p.l)}).l AS redacted_text FROM k""",
    "match_listing": _F + f"SELECT session, label, original, CASE WHEN regexp_full_match(original, {sql_string(_EMAIL)}) THEN 'private_email' ELSE 'unknown' END AS type, row_number() OVER (PARTITION BY session ORDER BY label) AS place FROM (SELECT *, '<<REDACTED_REGEX_' || CAST(n AS VARCHAR) || '>>' AS label FROM n)",
    "profile_totals": f"SELECT source AS profile, count(*) AS n_requests, CAST(coalesce(sum(len(list_distinct(regexp_extract_all(text, {sql_string(_EMAIL)})))), 0) AS BIGINT) AS n_pii, CAST(coalesce(sum(len(list_distinct(regexp_extract_all(text, {sql_string(_CARD)})))), 0) AS BIGINT) AS n_regex, {len(KEYWORDS)} * count(*) AS n_keyword FROM documents GROUP BY source",
    "fragment_cache_first": "SELECT doc_id, source AS session, min(doc_id) OVER (PARTITION BY source, text) AS first_doc FROM documents",
    "unredact_roundtrip": "SELECT doc_id, text AS restored_text FROM documents",
    "profile_stats": _F + """, r AS (SELECT m.session, m.text, count(DISTINCT n.original) AS k FROM m JOIN n ON m.session = n.session AND list_contains(m.ms, n.original) GROUP BY ALL)
SELECT source AS profile, count(*) AS n_requests, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_regex FROM documents LEFT JOIN r ON source = r.session AND documents.text = r.text GROUP BY source""",
}
QUERIES = {f.__name__: f for f in (session_label_numbering, pii_label_numbering, session_redact, session_dictionary, profile_redact, forward_propagation, fragment_cache_first, unredact_roundtrip, profile_stats, profile_totals, match_listing, request_label_counts)}
