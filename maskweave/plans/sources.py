"""Queries over captured requests, sealed texts and sealed settings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions import text as T
from maskweave.operators import ranks, report
from maskweave.sources import settings, traffic, vault
from maskweave.storage import fresh_path
from maskweave.streaming.parts import run_parts
from maskweave.streaming.requests import OUTPUT as REQUESTS
from maskweave.streaming.requests import requests

#: Bytes of a captured chunk.
CAPTURED = 300


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured requests of conversations' turns, taken apart."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.coalesce("text", F.lit(""))
    raw = F.concat(F.lit("POST /v1/chat?x=1 HTTP/1.1\r\nHost: h:1\r\nX-Role:  "), F.col("role"), F.lit("\r\ncontent-length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("rest"))
    r = t.select("conv_id", "turn", traffic.parsed_request(raw).alias("r"))
    return r.select("conv_id", "turn", "r.method", "r.path", "r.version", F.col("r.headers")["X-Role"].alias("x_role"), F.col("r.body").alias("body"))


def captured_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests of their conversation's connection, captured in chunks that come out of order, framed by a stream and taken apart."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    raw = F.concat(F.lit("POST /v1/chat/completions?turn="), F.col("turn").cast("string"), F.lit(" HTTP/1.1\r\nHost: h\r\nContent-Length: "), F.octet_length("text").cast("string"), F.lit("\r\n\r\n"), F.col("text")).cast("binary")
    n = F.ceil(F.octet_length("raw") / CAPTURED).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("raw", i * CAPTURED + 1, F.lit(CAPTURED)))
    cut = t.select(F.col("conv_id").cast("string").alias("connection"), "turn", raw.alias("raw")).select("connection", "turn", F.posexplode(pieces).alias("piece", "data"))
    chunks = ranks.numbered(cut, ["connection"], ["turn", "piece"], "seq").select("connection", "seq", "data", F.lit("2024-01-01").cast("timestamp").alias("sent"))
    framed = run_parts([chunks.where("seq % 3 > 0"), chunks.where("seq % 3 = 0")], requests, REQUESTS, fresh_path(spark, "capture"))
    r = framed.select(F.col("connection").cast("long").alias("conv_id"), "number", traffic.parsed_request(F.col("raw")).alias("r"))
    return r.select("conv_id", "number", "r.method", "r.path", F.col("r.body").alias("body"))


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file for each brand of items, every third one broken: scanned, the broken ones put aside, the others migrated."""
    brands = spark.read.parquet(f"{sf_dir}/items.parquet").where("brand is not null").groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    text = F.to_json(F.struct(F.lit(1).alias("settings_version"), (F.col("n") % 2 == 0).alias("verbose_logging"), F.col("kind").alias("app_language")))
    path = fresh_path(spark, "settings-files")
    brands.select("brand", F.when(F.col("n") % 3 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value")).repartition("brand").write.partitionBy("brand").text(path)
    found = settings.read(spark, f"{path}/*/part-*")
    read = lambda c: F.get_json_object("value", f"$.{c}")
    return found.select(F.regexp_extract("path", "brand=([^/]*)/", 1).alias("brand"), "corrupt", read("app_language").alias("app_language"), read("logging_enabled").cast("boolean").alias("logging_enabled"), read("settings_version").cast("long").alias("version"))


def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows, appended to the logs of two sessions and of one whose log is off, and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    logs = e.select("event_id", F.element_at(F.array(F.lit("UserToProxy"), F.lit("ProxyToLLM")), (F.col("event_id") % 2 + 1).cast("int")).alias("direction"), F.col("props").alias("details"), (F.col("user_id") % 3).alias("s"))
    path = fresh_path(spark, "logs")
    for s, enabled, sensitive in ((0, True, False), (1, True, True), (2, False, True)):
        traffic.append_log(report.logged(logs.where(F.col("s") == s), enabled, sensitive).drop("s"), path, f"s{s}", show_sensitive=True)
    return spark.read.schema("event_id long, direction string, details string, session string").json(path)


def time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the month and the milliseconds of their time, and whether a fresh id has an id's form."""
    at = F.col("sold_at").cast("timestamp")
    form = T.new_id().rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return spark.read.parquet(f"{sf_dir}/sales.parquet").select("sale_id", T.month_of(at).alias("month"), T.millis_of(at).alias("millis"), form.alias("id_form"))


def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' cities by source, the last written of each."""
    rows = spark.read.parquet(f"{sf_dir}/client_changes.parquet").where("source is not null")
    return report.last_written(rows, ["client_id"], "source", "city", ["seq", "change_id"])


def vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed under a wrapped key and opened again; another key opens none."""
    salt, wrapped = vault.wrap(spark, b"k" * 32, "master")
    key = vault.unwrap(spark, wrapped, "master", salt)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = vault.sealed(d, ["text"], key)
    other = vault.key_column(spark, b"x" * 32)
    return s.select("doc_id", vault.opened(F.col("text"), vault.key_column(spark, key)).alias("opened"), vault.opened(F.col("text"), other).isNull().alias("locked"))


def settings_sealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings document for each client, written sealed, and what its file's lines hold with and without the key."""
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    keyword = F.struct(F.col("name").alias("text"))
    profile = F.struct(F.col("client_id").cast("string").alias("id"), F.col("email").alias("api_key"), F.array(keyword).alias("keywords"), F.col("city").alias("alias"))
    path = fresh_path(spark, "settings")
    settings.write(clients.select(F.to_json(F.struct(F.array(profile).alias("profiles"))).alias("value")), path, key=_KEY)
    lines = settings.read_lines(spark, path).withColumn("opened", F.col("value"))
    both = settings.opened(lines, _KEY, "opened")
    of = lambda c, p: F.get_json_object(c, f"$.profiles[0].{p}")
    return both.select(of("opened", "id").cast("long").alias("client_id"), of("opened", "api_key").alias("api_key"), of("opened", "keywords[0].text").alias("keyword"), of("opened", "alias").alias("alias"), of("value", "keywords._mode").alias("mode"), of("value", "api_key._mode").alias("key_mode"))


_KEY = b"0123456789abcdef" * 2
SQL = {
    "request_parse": "SELECT conv_id, turn, 'POST' AS method, '/v1/chat?x=1' AS path, 'HTTP/1.1' AS version, role AS x_role, coalesce(text, '') AS body FROM conversations",
    "settings_sealing": f"SELECT client_id, email AS api_key, name AS keyword, city AS alias, '{vault.MODE}' AS mode, CASE WHEN email IS NOT NULL THEN '{vault.MODE}' END AS key_mode FROM clients",
    "captured_requests": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS number, 'POST' AS method, '/v1/chat/completions?turn=' || turn AS path, text AS body FROM conversations WHERE text IS NOT NULL",
    "settings_files": """
SELECT brand, n % 3 = 0 AS corrupt, CASE WHEN n % 3 = 0 THEN '' ELSE kind END AS app_language, n % 3 <> 0 AND n % 2 = 0 AS logging_enabled, CAST(2 AS BIGINT) AS version
FROM (SELECT brand, count(*) AS n, coalesce(min(kind), '') AS kind FROM items WHERE brand IS NOT NULL GROUP BY brand)""",
    "log_sink": """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'UserToProxy' ELSE 'ProxyToLLM' END AS direction, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN strlen(props) || ' bytes (body omitted)' ELSE props END AS details, 's' || user_id % 3 AS session
FROM events WHERE user_id % 3 < 2""",
    "time_keys": "SELECT sale_id, strftime(sold_at, '%Y-%m') AS month, epoch_ms(sold_at) AS millis, true AS id_form FROM sales",
    "last_values": "SELECT client_id, source, city FROM client_changes WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, source ORDER BY seq DESC, change_id DESC) = 1",
    "vault_roundtrip": "SELECT doc_id, text AS opened, true AS locked FROM documents",
}
QUERIES = {n: globals()[n] for n in SQL}
