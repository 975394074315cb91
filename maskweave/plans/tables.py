"""Queries over events, pages and documents: rings, logs, profiles, scalars."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import PREVIEW_CHARS, RTL_LANGUAGES
from maskweave.functions import text as T
from maskweave.operators import profiles, report, session


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumns({"alias": F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")), "port": (F.col("user_id") % 7 + 8080).cast("int")})


def match_ring_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.last_per_key(_events(spark, sf_dir), "alias", "event_id")
    return out.select("alias", "event_id", F.col("rank").cast("long").alias("rank"))


def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recent(_events(spark, sf_dir), "event_id").select("event_id", "alias", "event_type", "place")


def logs_for_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.of_alias(_events(spark, sf_dir), "p3", "event_id", 50).select("event_id", "alias", "place")


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", report.match_line(F.col("ts"), F.col("event_type"), F.col("alias"), F.col("props")).alias("line"))


def log_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.element_at(F.array(*map(F.lit, ("UserToProxy", "ProxyToLLM", "LLMToProxy", "ProxyToUser"))), (F.col("event_id") % 4 + 1).cast("int"))
    logs = _events(spark, sf_dir).select("event_id", direction.alias("direction"), F.col("props").alias("details"))
    return report.masked_log(logs, show_sensitive=False)


def config_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session.session_epochs(_events(spark, sf_dir), "alias", "event_id", "event_type")
    return out.select("event_id", "alias", "epoch")


def type_breakdown_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type for each alias, from the map of each."""
    out = report.type_breakdown(_events(spark, sf_dir), ["alias"], "event_type")
    return out.select("alias", F.explode("breakdown").alias("event_type", "n"))


_PROFILES = [("a", 8080, 0, True), ("b", 8081, 1, True), ("c", 8081, 2, True), ("d", 8083, 3, False), ("e", 8084, 4, True)]


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PROFILES, "id string, port int, place int, enabled boolean")


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by port with their profile, if any."""
    out = profiles.bind(_events(spark, sf_dir).select("event_id", "port"), _profiles(spark))
    return out.select("event_id", "port", F.col("id").alias("profile"))


def endpoint_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs with an API suffix by page id, classified."""
    suffix = F.element_at(F.array(*map(F.lit, ("/V1/messages?x=1", "/chat/completions", "/v1/models", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.endpoint(F.concat(F.split_part("url", F.lit("?"), F.lit(1)), suffix)).alias("endpoint"))


def lang_rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "ar").when(F.col("doc_id") % 3 == 1, "arx").otherwise(F.col("lang")), F.lit("-X")).alias("tag"))
    return d.select("doc_id", "tag", T.is_rtl(F.col("tag")).alias("rtl"))


def lang_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.language_matches(F.concat("lang", F.lit("-DE")), F.lit("de")).alias("down"), T.language_matches(F.lit("fr"), F.concat("lang", F.lit("-FR"))).alias("up"))


def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") + 1)
    return read(spark, sf_dir, "documents").select("doc_id", T.format_size(n).alias("size"))


def float_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with two decimals, with a point and with a comma, and read back."""
    e = _events(spark, sf_dir).select("event_id", T.format_float(F.col("value"), 2).alias("point"), T.format_float(F.col("value"), 2, comma=True).alias("comma"))
    return e.withColumn("back", T.parse_float(F.concat("comma", F.lit(" x")), comma=True))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", T.request_summary(F.lit("POST"), F.col("event_type"), F.col("event_id") % 3, F.col("event_id") % 2, F.lit(0)).alias("summary"))


def preview_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


def trim_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit(" \t\f"), F.col("text"), F.lit("\u000b\r\n "))
    return read(spark, sf_dir, "documents").select("doc_id", T.trim_ws(s).alias("trimmed"))


def split_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at blanks, without an empty tail."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.split_on(F.col("text"), " ").alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("joined"))


def message_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.format_message(F.lit("{0} of {1} in {0}"), F.col("source"), F.col("lang")).alias("message"))


_HEADERS = "map('Host', 'h', 'Authorization', 'Bearer dummy', 'X-Api-Key', 'k', 'Accept-Encoding', 'gzip', 'Content-Encoding', 'br', 'X-Id', CAST(event_id AS STRING))"


def config_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different configurations of each alias, by the hash that names them."""
    e = _events(spark, sf_dir).select("alias", "event_type", (F.col("event_id") % 7 == 0).alias("logs"))
    named = e.select("alias", profiles.config_hash(["event_type", "logs"]).alias("config"))
    return named.groupBy("alias").agg(F.count_distinct("config").alias("n_configs"))


def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.expr(_HEADERS).alias("h"))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return e.select("event_id", names(T.kept_headers(F.col("h"))).alias("request_headers"), names(T.kept_headers(F.col("h"), response=True)).alias("response_headers"))


def credential_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("map('X-Id', 'i')")).otherwise(F.expr(_HEADERS)).alias("h"))
    for_log = T.with_credentials(F.col("h"), F.lit("<REDACTED>"))
    return e.select("event_id", for_log["Authorization"].alias("authorization"), for_log["X-Api-Key"].alias("x_api_key"))


def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit(700).cast("long"))
    b = T.range_bounds(F.lit(10).cast("long"), F.when(F.col("doc_id") % 3 == 0, F.lit(100).cast("long")), tail, F.col("n_chars"))
    return d.select("doc_id", b["first"].alias("first_byte"), b["last"].alias("last_byte"))


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths as /lang/number, held against a route with an optional part."""
    path = F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1)
    p = read(spark, sf_dir, "pages").select("page_id", T.route_params(path, "/:lang/:item?").alias("m"))
    return p.select("page_id", F.col("m").isNotNull().alias("fits"), F.col("m")["lang"].alias("lang"), F.col("m")["item"].alias("item"))


_E = "(SELECT *, 'p' || CAST(user_id % 10 AS VARCHAR) AS alias, CAST(user_id % 7 + 8080 AS INT) AS port FROM events)"
_P = "(VALUES " + ", ".join(f"('{i}', {p}, {o}, {str(e).lower()})" for i, p, o, e in _PROFILES) + ") AS p(id, port, place, enabled)"
SQL = {
    "match_ring_200": f"SELECT alias, event_id, rank FROM (SELECT alias, event_id, row_number() OVER (PARTITION BY alias ORDER BY event_id DESC) AS rank FROM {_E}) WHERE rank <= 200",
    "recent_logs": f"SELECT *, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT event_id, alias, event_type FROM {_E} ORDER BY event_id DESC LIMIT 100)",
    "logs_for_profile": f"SELECT event_id, alias, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT * FROM (SELECT * FROM {_E} ORDER BY event_id DESC LIMIT 1000) WHERE alias = 'p3' ORDER BY event_id DESC LIMIT 50)",
    "match_lines": f"SELECT event_id, '[' || strftime(ts, '%H:%M:%S') || '] ' || event_type || ' (' || alias || '): ' || props AS line FROM {_E}",
    "log_masking": f"SELECT event_id, ['UserToProxy', 'ProxyToLLM', 'LLMToProxy', 'ProxyToUser'][event_id % 4 + 1] AS direction, CASE WHEN event_id % 4 IN (0, 3) THEN CAST(strlen(props) AS VARCHAR) || ' bytes (body omitted)' ELSE props END AS details FROM {_E}",
    "config_epoch": f"SELECT event_id, alias, CAST(sum(c) OVER (PARTITION BY alias ORDER BY event_id) AS BIGINT) AS epoch FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY alias ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS c FROM {_E})",
    "type_breakdown_map": f"SELECT alias, event_type, count(*) AS n FROM {_E} GROUP BY ALL",
    "profile_lookup": f"SELECT event_id, e.port, q.id AS profile FROM {_E} AS e LEFT JOIN (SELECT port, arg_min(id, place) AS id FROM {_P} WHERE enabled GROUP BY port) AS q ON e.port = q.port",
    "endpoint_class": """
SELECT page_id, CASE WHEN ends_with(p, '/v1/messages') THEN '/v1/messages' WHEN ends_with(p, '/v1/chat/completions') THEN '/v1/chat/completions' WHEN ends_with(p, '/v1/models') THEN '/v1/models'
  WHEN ends_with(p, '/messages') THEN '/messages' WHEN ends_with(p, '/chat/completions') THEN '/chat/completions' WHEN ends_with(p, '/models') THEN '/models' ELSE p END AS endpoint
FROM (SELECT page_id, lower(split_part(split_part(url, '?', 1) || ['/V1/messages?x=1', '/chat/completions', '/v1/models', ''][page_id % 4 + 1], '?', 1)) AS p FROM pages)""",
    "lang_rtl": "SELECT doc_id, tag, split_part(tag, '-', 1) IN (" + ", ".join(f"'{x}'" for x in RTL_LANGUAGES) + ") AS rtl FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'arx' ELSE lang END || '-X' AS tag FROM documents)",
    "lang_match": "SELECT doc_id, lang = 'de' AS down, lang = 'fr' AS up FROM documents",
    "format_size": """
SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size
FROM (SELECT doc_id, n_chars * n_chars * (doc_id + 1) AS n FROM documents)""",
    "float_format": "SELECT event_id, p AS point, replace(p, '.', ',') AS comma, CAST(p AS DOUBLE) AS back FROM (SELECT event_id, printf('%.2f', value) AS p FROM events)",
    "log_summary": "SELECT event_id, 'POST ' || event_type || CASE WHEN event_id % 3 > 0 THEN ' | PII ' || CAST(event_id % 3 AS VARCHAR) ELSE '' END || CASE WHEN event_id % 2 > 0 THEN ' | Regex 1' ELSE '' END AS summary FROM events",
    "preview_truncate": f"SELECT doc_id, CASE WHEN length(text) > {PREVIEW_CHARS} THEN substr(text, 1, {PREVIEW_CHARS}) || '...[truncated]' ELSE text END AS preview FROM documents",
    "trim_ws": "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS trimmed FROM documents",
    "split_tail": """
SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, '|') AS joined
FROM (SELECT doc_id, CASE WHEN q[-1] = '' THEN q[1:len(q) - 1] ELSE q END AS p FROM (SELECT doc_id, string_split(text, ' ') AS q FROM documents))""",
    "message_format": "SELECT doc_id, source || ' of ' || lang || ' in ' || source AS message FROM documents",
    "config_identity": f"SELECT alias, count(DISTINCT event_type || (event_id % 7 = 0)) AS n_configs FROM {_E} GROUP BY alias",
    "header_filter": "SELECT event_id, 'Authorization,Content-Encoding,X-Api-Key,X-Id' AS request_headers, 'Accept-Encoding,Authorization,Host,X-Api-Key,X-Id' AS response_headers FROM events",
    "credential_mask": "SELECT event_id, 'Bearer <REDACTED>' AS authorization, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '<REDACTED>' END AS x_api_key FROM events",
    "range_bounds": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN greatest(0, n_chars - 700) ELSE 10 END AS first_byte,
       CASE WHEN doc_id % 2 = 0 THEN n_chars - 1 WHEN doc_id % 3 = 0 THEN 10 + least(100, n_chars - 10) - 1 ELSE n_chars - 1 END AS last_byte FROM documents""",
    "route_match": r"""
SELECT page_id, regexp_matches(p, '^/+[^/]+(/+[^/]+)?/*$') AS fits, nullif(regexp_extract(p, '^/+([^/]+)(?:/+([^/]+))?/*$', 1), '') AS lang, nullif(regexp_extract(p, '^/+([^/]+)(?:/+([^/]+))?/*$', 2), '') AS item
FROM (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS p FROM pages)""",
}
QUERIES = {n: globals()[n] for n in SQL}
