"""Queries over profiles, settings, versions and paths that are made of the shop's clients and items, and of pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import DEFAULT_PORT, UPDATE_CHANNEL, UPDATE_FILE
from maskweave.functions import text as T
from maskweave.functions.core import sql_string
from maskweave.operators import profiles, report
from maskweave.sources import settings


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


#: Patterns that profiles may have; the third does not compile.
_PATTERNS = ("a+", r"\d{2}", "(b", " ")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each client: ports repeat, upstreams and thresholds are not always right."""
    c, n = _read(spark, sf_dir, "clients"), F.col("client_id")
    url = F.when(F.col("segment") == "public", "").when(F.col("segment") == "retail", F.concat(F.lit("ftp://"), "city")).when(F.col("segment").isNotNull(), F.concat(F.lit("HTTPS://"), "source"))
    pattern = F.struct(_pick(n, *_PATTERNS).alias("pattern"), F.lit(True).alias("enabled"))
    return c.select(
        F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(n % 50 == 7, n % 1000).otherwise(n * 37 % 700 + 7900).cast("int").alias("port"), n.alias("place"), (n % 5 > 0).alias("enabled"),
        url.alias("upstream_url"), (F.col("balance") / 4000).alias("threshold"), F.array(pattern).alias("regex_patterns"), "client_id",
    )


def port_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose port another one has, with the first of the others."""
    return profiles.port_conflicts(_profiles(spark, sf_dir).select("id", "port"))


def free_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first port that no client's profile uses."""
    return profiles.free_port(spark, _profiles(spark, sf_dir))


def profile_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of clients that no change has deleted."""
    gone = _read(spark, sf_dir, "client_changes").where("op = 'D'").select("client_id").distinct()
    return profiles.removed(_profiles(spark, sf_dir), gone, "client_id").select("id", "port")


def profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the port and the upstream of their client's last change, where it has them."""
    last = _read(spark, sf_dir, "client_changes").groupBy("client_id").agg(F.max_by(F.struct("seq", "city"), F.struct("seq", "change_id")).alias("c"))
    changes = last.select("client_id", (F.col("c.seq") + 9000).cast("int").alias("port"), F.concat(F.lit("https://"), "c.city").alias("upstream_url"))
    return profiles.updated(_profiles(spark, sf_dir), changes, "client_id").select("id", "port", "upstream_url")


def profile_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule that a profile breaks."""
    return profiles.problems(_profiles(spark, sf_dir))


def profile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' profiles as JSON with a field or two left out, a key sealed or not, and what parsing fills in."""
    n, name = F.col("client_id"), F.col("name")
    keywords = F.when(n % 3 == 0, F.array(F.struct(name.alias("text")))).when(n % 3 == 1, F.array(F.struct(name.alias("text")), F.struct(F.lit("x").alias("text"))))
    some = F.struct(
        F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(n % 2 == 0, F.col("email")).alias("api_key"), F.when(n % 4 == 0, n % 9000).alias("port"),
        F.when(n % 5 == 0, F.lit(False)).alias("enabled"), keywords.alias("keywords"),
    )
    text = F.when(n % 7 == 3, F.replace(F.to_json(some), F.lit('"id"'), F.lit('"api_key":{"_enc":"zz"},"id"'))).otherwise(F.to_json(some))
    rows = _read(spark, sf_dir, "clients").where("client_id % 14 <> 10").select(text.alias("value"))
    p = profiles.parse_profiles(rows)
    return p.select("id", "api_key", F.col("port").cast("long").alias("port"), "enabled", F.size("keywords").cast("long").alias("n_keywords"), F.coalesce(F.get("keywords", F.lit(0))["case_sensitive"], F.lit(False)).alias("first_cs"))


def settings_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' settings of several versions, some of them broken, at the present version."""
    n = F.col("client_id")
    some = F.struct(
        F.when(n % 4 > 0, _pick(n, 0, 1, 2, 9)).alias("settings_version"), F.when(n % 3 < 2, n % 3 == 0).alias("verbose_logging"), F.when(n % 5 == 0, F.lit(True)).alias("logging_enabled"),
        F.when(n % 7 > 0, F.col("city")).alias("app_language"), (F.col("balance") > 2000).alias("start_on_boot"),
    )
    whole = F.to_json(some)
    # a document without any field is {}, shorter than what is left of others
    broken = F.substring(whole, F.lit(1), F.least(F.lit(9), F.length(whole) - 1))
    text = F.when(n % 11 == 5, broken).otherwise(whole)
    return settings.migrated(_read(spark, sf_dir, "clients").select(n.alias("id"), text.alias("value"))).select("id", "corrupt", "value")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("item_id"), lambda c: c.cast("string")
    a, b, c = text(F.col("size") % 5), text(n % 11), text(n % 3)
    form = F.when(n % 8 == 1, F.concat_ws(".", a, b)).when(n % 8 == 2, a).when(n % 8 == 4, F.concat(F.lit("x."), b)).when(n % 8 == 5, F.concat(a, F.lit(".."), c))
    whole = F.concat(F.concat_ws(".", a, b, c), F.when(n % 8 == 3, "-beta").when(n % 8 == 6, "+b").otherwise(""))
    return _read(spark, sf_dir, "items").select("item_id", "name", F.coalesce(form, whole).alias("remote"), F.concat_ws(".", text(F.col("size") % 4), text(n % 9), F.lit("0")).alias("local"))


def semver_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' versions, of several forms, against others."""
    return _versions(spark, sf_dir).select("item_id", "remote", T.is_newer(F.col("remote"), F.col("local")).alias("newer"))


def latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of the items as release assets."""
    n = F.col("item_id")
    rows = _versions(spark, sf_dir).select(n.alias("place"), _pick(n, "Full", "Delta", "1").alias("type"), F.col("remote").alias("version"), F.when(n % 13 > 0, F.col("name")).alias("file_name"))
    return report.latest_release(rows)


def path_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths after bases that share a part with them, or none."""
    path = F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1)
    parts = F.split(path, "/")
    n = F.col("page_id")
    lang = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    base = F.when(n % 5 == 0, "/api").when(n % 5 == 1, F.concat(F.lit("/api/"), lang)).when(n % 5 == 2, F.concat(F.lit("/"), lang, F.lit("/"))).when(n % 5 == 3, "").otherwise(F.concat(F.lit("/x"), path))
    p = _read(spark, sf_dir, "pages").select("page_id", base.alias("base"), path.alias("path"))
    return p.withColumn("joined", T.joined_path(F.col("base"), F.col("path")))


def update_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files named after pages an update feed serves."""
    n = F.col("page_id")
    item = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    file = F.when(n % 6 == 0, F.concat(F.lit("releases."), item, F.lit(".json"))).otherwise(F.concat(item, _pick(n, "", ".nupkg", "/b.nupkg", "-Setup.exe", "-Portable.zip", ".EXE")))
    rows = _read(spark, sf_dir, "pages").select("page_id", _pick(n, "win", "win-arm64", "mac", "win").alias("channel"), file.alias("file"))
    return rows.withColumn("served", F.col("channel").rlike(UPDATE_CHANNEL) & F.col("file").rlike(UPDATE_FILE))


_P = r"""WITH p AS (
  SELECT 'p' || client_id AS id, CAST(CASE WHEN client_id % 50 = 7 THEN client_id % 1000 ELSE client_id * 37 % 700 + 7900 END AS INT) AS port, client_id, CASE WHEN segment = 'public' THEN '' WHEN segment = 'retail' THEN 'ftp://' || city WHEN segment IS NOT NULL THEN 'HTTPS://' || source END AS url,
         balance / 4000 AS t FROM clients
)"""
_PARTS = "(SELECT item_id, name, remote, local, CASE WHEN list_contains(r, '') THEN NULL ELSE list_concat(list_transform(r, lambda x: CAST(x AS INT)), [0, 0])[1:3] END AS rp, list_transform(string_split(local, '.'), lambda x: CAST(x AS INT)) AS lp FROM (SELECT *, list_transform(string_split(regexp_extract(remote, '^([^-+]*)', 1), '.')[1:3], lambda x: regexp_extract(x, '^\\s*([+-]?\\d+)', 1)) AS r FROM v))"
_V = """WITH v AS (
  SELECT item_id, name, CASE item_id % 8 WHEN 1 THEN a || '.' || b WHEN 2 THEN a WHEN 4 THEN 'x.' || b WHEN 5 THEN a || '..' || c ELSE a || '.' || b || '.' || c || CASE item_id % 8 WHEN 3 THEN '-beta' WHEN 6 THEN '+b' ELSE '' END END AS remote, l AS local
  FROM (SELECT item_id, name, CAST(size % 5 AS VARCHAR) AS a, CAST(item_id % 11 AS VARCHAR) AS b, CAST(item_id % 3 AS VARCHAR) AS c, (size % 4) || '.' || (item_id % 9) || '.0' AS l FROM items)
)"""
SQL = {
    "port_conflicts": _P + "SELECT a.id, min(b.id) AS other, a.port FROM p AS a JOIN p AS b ON a.port = b.port AND a.id <> b.id GROUP BY a.id, a.port",
    "free_port": _P + f"SELECT min(port) AS port FROM (SELECT unnest(range({DEFAULT_PORT}, 65536)) AS port) WHERE port NOT IN (SELECT port FROM p)",
    "profile_removal": _P + "SELECT id, port FROM p WHERE client_id NOT IN (SELECT client_id FROM client_changes WHERE op = 'D' AND client_id IS NOT NULL)",
    "profile_update": _P + """, c AS (SELECT client_id, seq, city FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1)
SELECT id, CAST(coalesce(9000 + seq, port) AS INT) AS port, coalesce('https://' || c.city, url) AS upstream_url FROM p LEFT JOIN c ON p.client_id = c.client_id""",
    "profile_problems": _P + """
SELECT id, 'port out of range' AS error FROM p WHERE port NOT BETWEEN 1024 AND 65535
UNION ALL SELECT id, 'port already used' FROM p WHERE port IN (SELECT port FROM p GROUP BY port HAVING count(*) > 1)
UNION ALL SELECT id, 'upstream missing' FROM p WHERE coalesce(url, '') = ''
UNION ALL SELECT id, 'upstream is not http' FROM p WHERE coalesce(url, '') <> '' AND NOT regexp_matches(lower(url), '^https?://')
UNION ALL SELECT id, 'threshold out of range' FROM p WHERE t NOT BETWEEN 0 AND 1
UNION ALL SELECT id, 'pattern does not compile' FROM p WHERE client_id % 4 = 2""",
    "profile_parse": f"""
SELECT 'p' || client_id AS id, CASE WHEN client_id % 7 = 3 OR client_id % 2 = 1 THEN '' ELSE coalesce(email, '') END AS api_key, CASE WHEN client_id % 4 = 0 THEN client_id % 9000 ELSE {DEFAULT_PORT} END AS port, client_id % 5 <> 0 AS enabled,
       CASE client_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_keywords, client_id % 3 < 2 AS first_cs
FROM clients WHERE client_id % 14 <> 10""",
    "settings_migrate": """
WITH s AS (
  SELECT client_id AS id, client_id % 11 = 5 AS corrupt, [1, 1, 2, 9][client_id % 4 + 1] AS v, CASE WHEN client_id % 3 < 2 THEN client_id % 3 = 0 END AS said, CASE WHEN client_id % 5 = 0 THEN true END AS logs,
         CASE WHEN client_id % 7 > 0 THEN city END AS lang, balance > 2000 AS boot FROM clients
)
SELECT id, corrupt, CASE WHEN corrupt THEN '{"app_language":"","logging_enabled":false,"settings_version":2,"start_on_boot":true}'
  ELSE '{"app_language":"' || coalesce(lang, '') || '","logging_enabled":' || coalesce(logs, CASE WHEN v < 2 THEN said END, false) || ',"settings_version":' || greatest(v, 2) || ',"start_on_boot":' || coalesce(boot, true)
    || CASE WHEN v >= 2 AND said IS NOT NULL THEN ',"verbose_logging":' || said ELSE '' END || '}' END AS value
FROM s""",
    "semver_newer": _V + f"SELECT item_id, remote, coalesce(rp > lp, false) AS newer FROM {_PARTS}",
    "latest_release": _V + f"SELECT remote AS version, name AS file_name FROM {_PARTS} WHERE item_id % 3 <> 1 AND item_id % 13 > 0 AND name <> '' ORDER BY coalesce(rp, [-1]) DESC, item_id LIMIT 1",
    "path_concat": r"""
WITH u AS (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN '/api' WHEN 1 THEN '/api/' || l WHEN 2 THEN '/' || l || '/' WHEN 3 THEN '' ELSE '/x' || path END AS base FROM (SELECT *, coalesce(string_split(path, '/')[2], '') AS l FROM u)),
c AS (SELECT *, CASE WHEN ends_with(base, '/') THEN left(base, length(base) - 1) ELSE base END AS bare FROM b),
s AS (SELECT *, left(bare, length(bare) - coalesce(list_max(list_filter(range(1, least(length(bare), length(path)) + 1), lambda i: right(bare, i) = left(path, i))), 0)) AS kept FROM c)
SELECT page_id, base, path, CASE WHEN path = '' THEN bare WHEN ends_with(kept, '/') AND starts_with(path, '/') THEN left(kept, length(kept) - 1) || path ELSE kept || path END AS joined FROM s""",
    "update_files": rf"""
SELECT *, regexp_matches(channel, {sql_string(UPDATE_CHANNEL)}) AND regexp_matches(file, {sql_string(UPDATE_FILE)}) AS served FROM (
  SELECT page_id, ['win', 'win-arm64', 'mac', 'win'][page_id % 4 + 1] AS channel, CASE WHEN page_id % 6 = 0 THEN 'releases.' || item || '.json' ELSE item || ['', '.nupkg', '/b.nupkg', '-Setup.exe', '-Portable.zip', '.EXE'][page_id % 6 + 1] END AS file
  FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS item FROM pages))""",
}
QUERIES = {n: globals()[n] for n in SQL}
