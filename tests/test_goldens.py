"""Versions, paths, files, profiles and settings, case by case."""
import json

from pyspark.sql import functions as F

from maskweave.constants import UPDATE_CHANNEL, UPDATE_FILE
from maskweave.functions import text as T
from maskweave.operators import profiles, report
from maskweave.sources import settings


def test_versions(spark):
    cases = [("1.2.3", "1.2.2", True), ("1.10.0", "1.9.9", True), ("2.0", "2.0.0", False), ("2", "1.99.99-beta", True), ("x.1", "0.0.1", False), ("1..2", "1.0.0", False), ("1.2.3+b", "1.2.3", False), ("3.0.0-rc1", "2.9.9", True)]
    df = spark.createDataFrame(cases, "remote string, local string, want boolean")
    assert df.where(T.is_newer(F.col("remote"), F.col("local")) != F.col("want")).collect() == []
    rows = [(1, "Full", "1.2.0", "a"), (2, "Delta", "9.0.0", "b"), (3, "1", "1.10.0", "c"), (4, "Full", "1.10.0", "d"), (5, "Full", "2.0.0", ""), (6, "Full", "", "f")]
    assert report.latest_release(spark.createDataFrame(rows, "place long, type string, version string, file_name string")).first()[:] == ("1.10.0", "c")


def test_paths_and_files(spark):
    cases = [("/api/v1", "/v1/chat/completions", "/api/v1/chat/completions"), ("/", "/v1/messages", "/v1/messages"), ("/api", "/v1/models", "/api/v1/models"), ("/v1", "/v1/v1/x", "/v1/v1/x"), ("/api/v1/", "/v1/chat", "/api/v1/chat"), ("", "/x", "/x"), ("/a/", "", "/a")]
    df = spark.createDataFrame(cases, "base string, path string, want string")
    assert df.where(T.joined_path(F.col("base"), F.col("path")) != F.col("want")).collect() == []
    files = [("win", "releases.win.json", True), ("win-arm64", "app-1.0-full.nupkg", True), ("mac", "x-Setup.exe", False), ("win", "a/b.nupkg", False), ("win", "x-Portable.zip", True), ("win", "Releases.win.json", False)]
    df = spark.createDataFrame(files, "channel string, file string, want boolean")
    assert df.where((F.col("channel").rlike(UPDATE_CHANNEL) & F.col("file").rlike(UPDATE_FILE)) != F.col("want")).collect() == []


def test_profiles(spark):
    p = spark.createDataFrame([("a", 8080), ("b", 8081), ("c", 8081), ("d", 8083), ("e", 8081)], "id string, port int")
    assert sorted(tuple(r) for r in profiles.port_conflicts(p).collect()) == [("b", "c", 8081), ("c", "b", 8081), ("e", "b", 8081)]
    assert profiles.free_port(spark, p).first().port == 8082
    assert sorted(r.id for r in profiles.removed(p, spark.createDataFrame([("b",), ("x",)], "id string")).collect()) == ["a", "c", "d", "e"]
    changed = profiles.updated(p, spark.createDataFrame([("c", 9000), ("x", 9001)], "id string, port int"))
    assert {r.id: r.port for r in changed.collect()} == {"a": 8080, "b": 8081, "c": 9000, "d": 8083, "e": 8081}
    rows = [("a", 80, "https://x", 0.9, ["a+", "(b"]), ("b", 8081, "", 0.5, []), ("c", 8081, "ftp://x", 1.5, [" "]), ("d", 9000, "HTTP://ok", 0.0, ["\\d{2}"])]
    kinds = "id string, port int, upstream_url string, threshold double, regex_patterns array<struct<pattern:string,enabled:boolean>>"
    found = profiles.problems(spark.createDataFrame([(*r[:4], [(x, True) for x in r[4]]) for r in rows], kinds)).collect()
    assert sorted(tuple(r) for r in found) == [("a", "pattern does not compile"), ("a", "port out of range"), ("b", "port already used"), ("b", "upstream missing"), ("c", "port already used"), ("c", "threshold out of range"), ("c", "upstream is not http")]
    texts = ['{"id":"a","api_key":"k","keywords":[{"text":"x"}]}', '{"id":"b","port":9000,"api_key":{"_enc":"zz"},"enabled":false,"pii_confidence_threshold":0.5}']
    a, b = profiles.parse_profiles(spark.createDataFrame([(t,) for t in texts], "value string")).orderBy("id").collect()
    assert (a.api_key, a.port, a.enabled, a.keywords[0].case_sensitive) == ("k", 8080, True, True) and (b.api_key, b.port, b.enabled, b.keywords) == ("", 9000, False, [])


def test_settings(spark):
    base = {"app_language": "", "logging_enabled": False, "settings_version": 2, "start_on_boot": True}
    cases = [
        ('{"start_on_boot":true,"verbose_logging":true,"app_language":"de","more":"x"}', False, base | {"app_language": "de", "logging_enabled": True, "more": "x"}),
        ('{"settings_version":2,"logging_enabled":true,"app_language":"en"}', False, base | {"app_language": "en", "logging_enabled": True}),
        ('{"start_on_boot": tr', True, base), ('{"start_on_boot":"yes"}', False, base | {"start_on_boot": "yes"}), ("[1]", False, base),
        ('{"settings_version":9,"verbose_logging":true}', False, base | {"settings_version": 9, "verbose_logging": True}),
        ('{"verbose_logging":false,"logging_enabled":true}', False, base | {"logging_enabled": True}),
    ]
    rows = settings.migrated(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, value string")).orderBy("id").collect()
    assert [(r.corrupt, json.loads(r.value)) for r in rows] == [c[1:] for c in cases]
