"""Profiles: parsing with defaults, lookup, validation, updates and ports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import DEFAULT_PORT, DEFAULT_THRESHOLD, TRIMMED

PROFILE = """id string, alias string, upstream_url string, api_key string, port int, use_openai_model boolean, protocol_mode string,
enabled_pii_types array<string>, pii_confidence_threshold float, regex_patterns array<struct<pattern:string,enabled:boolean>>,
keywords array<struct<text:string,case_sensitive:boolean,enabled:boolean>>,
stats struct<total_requests:bigint,total_pii_detected:bigint,total_regex_matches:bigint,total_keyword_matches:bigint,pii_type_breakdown:map<string,bigint>>, enabled boolean"""


def parse_profiles(rows: DataFrame, body: str = "value") -> DataFrame:
    """JSON texts as profiles, with the default of each missing field. An encrypted key reads as empty."""
    p = rows.select(F.from_json(body, PROFILE).alias("p"), F.get_json_object(body, "$.api_key._enc").isNotNull().alias("_locked")).select("p.*", "_locked")
    true = F.lit(True)
    return p.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "alias", "upstream_url")],
        F.when(F.col("_locked"), "").otherwise(F.coalesce("api_key", F.lit(""))).alias("api_key"),
        F.coalesce("port", F.lit(DEFAULT_PORT)).alias("port"),
        F.coalesce("use_openai_model", true).alias("use_openai_model"),
        F.lit("none").alias("protocol_mode"),
        F.coalesce("enabled_pii_types", F.array().cast("array<string>")).alias("enabled_pii_types"),
        F.coalesce("pii_confidence_threshold", F.lit(DEFAULT_THRESHOLD).cast("float")).alias("pii_confidence_threshold"),
        F.transform(F.coalesce("regex_patterns", F.array().cast("array<struct<pattern:string,enabled:boolean>>")), lambda x: F.struct(F.coalesce(x["pattern"], F.lit("")).alias("pattern"), F.coalesce(x["enabled"], true).alias("enabled"))).alias("regex_patterns"),
        F.transform(F.coalesce("keywords", F.array().cast("array<struct<text:string,case_sensitive:boolean,enabled:boolean>>")), lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["case_sensitive"], true).alias("case_sensitive"), F.coalesce(x["enabled"], true).alias("enabled"))).alias("keywords"),
        "stats",
        F.coalesce("enabled", true).alias("enabled"),
    )


def profile_json(profiles: DataFrame) -> Column:
    return F.to_json(F.struct(*profiles.columns))


def config_hash(columns: list[str]) -> Column:
    """Names a configuration: equal for equal switches, threshold, types, patterns and keywords."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def bind(requests: DataFrame, profiles: DataFrame, key: str = "port") -> DataFrame:
    """Each request with the first enabled profile of its port; without one it stays, with nulls."""
    first = profiles.where("enabled").groupBy(key).agg(F.min_by(F.struct(*[c for c in profiles.columns if c != key]), "place").alias("_p"))
    return requests.join(first, key, "left").select(*requests.columns, "_p.*")


def broken_patterns(profiles: DataFrame) -> list[str]:
    """Patterns of profiles that don't compile. Profiles are configuration: their distinct patterns come to the driver."""
    from maskweave.operators.stateless import Pattern, usable_patterns

    every = [p for (p,) in profiles.select(F.explode("regex_patterns.pattern")).distinct().collect() if p and p.strip(TRIMMED)]
    return sorted({*every} - {*usable_patterns(profiles.sparkSession, [Pattern(p) for p in every])})


def problems(profiles: DataFrame) -> DataFrame:
    """(id, error) for each rule that a profile breaks; patterns are tried where there is a column of them."""
    shared = profiles.groupBy("port").agg(F.count(F.lit(1)).alias("n_on_port"))
    p = profiles.join(shared, "port")
    checks = {
        "port out of range": ~F.col("port").between(1024, 65535),
        "port already used": F.col("n_on_port") > 1,
        "upstream missing": F.coalesce("upstream_url", F.lit("")) == "",
        "upstream is not http": (F.coalesce("upstream_url", F.lit("")) != "") & ~F.lower("upstream_url").rlike("^https?://"),
        "threshold out of range": ~F.col("threshold").between(0, 1),
    }
    if "regex_patterns" in profiles.columns:
        broken = broken_patterns(profiles)
        checks["pattern does not compile"] = F.exists("regex_patterns.pattern", lambda x: x.isin(broken)) if broken else F.lit(False)
    errors = F.filter(F.array(*[F.when(bad, error) for error, bad in checks.items()]), lambda e: e.isNotNull())
    return p.select("id", F.explode(errors).alias("error"))


def port_conflicts(profiles: DataFrame) -> DataFrame:
    """(id, other, port) of the profiles whose port another one has; ``other``: the first of the others by id.

    One row for each profile, however many share a port: the port's two least ids tell all."""
    p = profiles.select("id", "port").distinct()
    first = p.groupBy("port").agg(F.min("id").alias("_first"))
    rest = p.join(first, "port").where("id <> _first")
    second = rest.groupBy("port").agg(F.min("id").alias("_second"))
    both = first.join(second, "port")
    return p.join(both, "port").select("id", F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("other"), "port")


def free_port(spark: SparkSession, used: DataFrame, first: int = 8080, last: int = 65535) -> DataFrame:
    """The first port of a range that none uses."""
    ports = spark.range(first, last + 1).select(F.col("id").alias("port"))
    return ports.join(used.select(F.col("port").cast("long")), "port", "left_anti").agg(F.min("port").alias("port"))


def removed(profiles: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return profiles.join(gone.select(key), key, "left_anti")


def updated(profiles: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Profiles with changed columns from ``changes``; a change without a profile adds none."""
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    out = profiles.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in profiles.columns])
