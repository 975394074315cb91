"""Quality rules with a verdict on the host.

Each document is measured, and each rule fails or holds for it. The failures of
a host (the ``source`` column) are counted, and its failure rate of each rule is
shrunk towards the rate of all documents with a beta prior fitted to the hosts by
moments of the beta-binomial: what chance alone scatters rates of small hosts is
taken off first, so hosts of one document tell nothing of how hosts differ. A
host with three bad documents is not judged like one with three million. A host
whose rate of any rule passes ``host_limit``, shrunk and as it is, is rejected,
and its documents with it.

Cases: a null or empty text has no words and fails; a null host gets no host
verdict; repeated rows are judged each; an empty table gives an empty result;
``measure`` replaces input columns that clash with the measures, the pipeline's
stage keeps columns of any name.
Everything is JVM side: no Python runs on the executors.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import Positions, let, table, upto, words
from maskweave.storage import compacted, few, in_few_files, stage

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines")
#: The prior weighs as much as so many documents: at least, at most.
LEAST_STRENGTH, MOST_STRENGTH = 10, 10_000
#: Positions take the low bits of a sort key; longer texts sort whole windows.
POSITION_BITS = 24


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    A primitive sort of (hash, position) keys finds windows that may repeat;
    only those are then compared word by word, so a hash can't add any."""
    n = F.size(w) - 2
    mask = (1 << POSITION_BITS) - 1

    def window(p: Column) -> list[Column]:
        return [F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)]

    def same(s: Column, i: Column, key) -> Column:
        here = key(F.get(s, i))
        return ((i > 0) & key(F.get(s, i - 1)).eqNullSafe(here)) | ((i < F.size(s) - 1) & key(F.get(s, i + 1)).eqNullSafe(here))

    packed = F.transform(upto(n), lambda p: F.xxhash64(*window(p)).bitwiseAND(F.lit(~mask)).bitwiseOR(p.cast("long")))
    high = lambda x: F.shiftright(x, POSITION_BITS)
    likely = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, i: same(s, i, high)))
    maybe = F.when(n <= mask, F.transform(likely, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))).otherwise(upto(n))

    def proven(cand: Column) -> Column:
        full = F.sort_array(F.transform(cand, lambda p: F.struct(F.array(*window(p)).alias("k"), p.alias("p"))))
        kept = let(full, lambda s: F.filter(s, lambda x, i: same(s, i, lambda y: y["k"])))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def covered(q: Column) -> Column:
        gaps = F.transform(q, lambda p, j: F.when(j < F.size(q) - 1, F.least(F.lit(3), F.get(q, j + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(maybe, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(let(proven(c), covered)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures, the rule failures and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long")})
    out = out.withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"_l.{c}") for c in ("n_lines", "n_dup_lines")}).drop("_w", "_l")
    out = out.withColumns({
        "fails_short": F.col("n_words") < 50,
        "fails_repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "fails_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "fails_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    })
    return out.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row for each host: documents, failures of each rule, shrunk rates."""
    hosts = (
        measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    )
    hosts = compacted(hosts, "hosts")
    sums = [F.sum("n_docs").alias("docs"), F.count(F.lit(1)).alias("hosts")]
    for r in RULES:  # one row of sums comes to the driver, whatever the number of hosts
        sums += [F.sum(f"n_{r}").alias(f"x_{r}"), F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"q_{r}")]
    row = hosts.agg(*sums).first()
    shrunk = {}
    for r in RULES:
        strength, m = prior(row["hosts"], row["docs"], row[f"x_{r}"], row[f"q_{r}"])
        shrunk[f"rate_{r}"] = (F.col(f"n_{r}") + F.lit(strength * m)) / (F.col("n_docs") + F.lit(strength))
        shrunk[f"raw_{r}"] = F.col(f"n_{r}") / F.col("n_docs")
    return hosts.withColumns(shrunk)


def prior(hosts: int, docs: int | None, failures: int | None, square: float | None) -> tuple[float, float]:
    """Strength (alpha + beta) and mean of the beta prior of hosts' failure rates.

    ``square``: the sum of failures squared over documents of each host. With the mean m, hosts' rates
    stray from it by m (1 - m) (hosts + rho (docs - hosts)) in the sum weighted by documents, of which the
    first part is chance; rho is how much documents of a host are alike, and strength is 1 / rho - 1."""
    if not docs:
        return float(MOST_STRENGTH), 0.5
    m = failures / docs
    chance = m * (1 - m)
    rho = ((square - docs * m * m) / chance - hosts) / (docs - hosts) if chance > 0 and docs > hosts else 0.0
    strength = 1 / rho - 1 if rho * MOST_STRENGTH > 1 else MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, strength))), m


def judge(measured: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """``measured`` with ``host_rejected`` and ``kept``. ``measured`` is read twice: stage it first."""
    worst = reduce(or_, [(F.col(f"rate_{r}") > host_limit) & (F.col(f"raw_{r}") > host_limit) for r in RULES])
    bad = compacted(host_rates(measured, host).where(worst).select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "bad-hosts")
    out = measured.join(few(bad), measured[host] == F.col("_host"), "left").withColumn("host_rejected", F.coalesce("_bad", F.lit(False))).drop("_host", "_bad")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = stage(measure(docs).drop("text"), "quality")
    return judge(measured).select("doc_id", *MEASURES, "base_failed", "kept", "host_rejected")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with the columns they came with, of whatever names."""
    held = Positions(docs)
    measured = stage(measure(held.rows, held["text"]), "quality")
    return in_few_files(held.back(judge(measured, held["source"]).where("kept")))


SQL = {
    "op2_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents
), g AS (
  SELECT rid, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)
), d AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1
), r AS (
  SELECT rid, CAST(count(DISTINCT p + k) AS BIGINT) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), m AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2,
         10 * n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM m
), long AS (
  SELECT source, k, count(*) AS n, sum(CAST(x AS INT)) AS bad
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS x FROM f WHERE source IS NOT NULL) GROUP BY source, k
), mom AS (
  SELECT k, sum(bad) / sum(n) AS mu, sum(n) AS docs, count(*) AS hosts, sum(bad * bad / n) AS q FROM long GROUP BY k
), rho AS (
  SELECT k, mu, CASE WHEN mu > 0 AND mu < 1 AND docs > hosts THEN ((q - docs * mu * mu) / (mu * (1 - mu)) - hosts) / (docs - hosts) ELSE 0 END AS r FROM mom
), pri AS (
  SELECT k, mu, least(10000, greatest(10, CASE WHEN r * 10000 > 1 THEN 1 / r - 1 ELSE 10000 END)) AS s FROM rho
), bad AS (
  SELECT DISTINCT source FROM long JOIN pri USING (k) WHERE (bad + s * mu) / (n + s) > 0.5 AND bad / n > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND bad.source IS NULL AS kept, bad.source IS NOT NULL AS host_rejected
FROM f LEFT JOIN bad ON f.source = bad.source
""",
}
QUERIES = {"op2_quality_rules": op2_quality_rules}
