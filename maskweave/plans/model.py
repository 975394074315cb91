"""Queries over embeddings taken as class scores, and over tokens."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions import bpe as B
from maskweave.functions import decode as D
from maskweave.functions.core import let

N_CLASSES, ROW = 33, 10
#: Characters of texts whose pieces are counted at a time.
COUNTED = 1 << 20
MERGES = [("t", "h"), ("th", "e"), ("e", "r"), ("i", "n"), ("Ġ", "the"), ("a", "n"), ("in", "g"), ("Ã", "©")]


def small_bpe() -> B.Bpe:
    """A small encoder: all bytes and a few merges."""
    pieces = [*B.byte_letters().values(), *("".join(m) for m in MERGES)]
    return B.Bpe({p: i + 1 for i, p in enumerate(pieces)}, MERGES)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, N_CLASSES).alias("x"))


def softmax_assigned_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest class's probability, shifted by the maximum."""

    def prob(x):
        m = F.array_max(x)
        return let(m, lambda top: 1 / F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top.cast("double"))))

    s = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    return s.select("vec_id", (F.array_position("x", F.array_max("x")) - 1).alias("class"), F.round(prob(F.col("x")), 6).alias("prob"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).groupBy(F.expr(f"vec_id div {ROW}").alias("seq_id"))
    return s.agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("rows"))


def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors at a time as the class scores of ten tokens; a row for each token's class."""
    names = D.class_names()
    step = D.transitions(names)

    @F.pandas_udf("array<bigint>")
    def path(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda xs: D.best_path(np.array([list(x) for x in xs], np.float32), names, step))

    p = _sequences(spark, sf_dir).select("seq_id", path(F.transform("rows", lambda r: r["x"])).alias("p"))
    return p.select("seq_id", F.posexplode("p").alias("token", "class")).select("seq_id", F.col("token").cast("long").alias("token"), "class")


def bioes_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the same paths over a text of ten words."""
    names = D.class_names()
    step = D.transitions(names)
    text = " ".join("abcdefghij")
    places = [(2 * i, 2 * i + 1) for i in range(ROW)]

    def found(xs) -> list[dict]:
        logits = np.array([list(x) for x in xs], np.float32)
        path = D.best_path(logits, names, step)
        return D.entities(path.tolist(), names, places, D.probabilities(logits, path).tolist(), {n[2:] for n in names[1:]}, text)

    @F.pandas_udf("array<struct<type:string,text:string,start:int,end:int,confidence:float>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(found)

    e = _sequences(spark, sf_dir).select("seq_id", F.explode(spans(F.transform("rows", lambda r: r["x"]))).alias("e"))
    return e.select("seq_id", "e.type", F.col("e.text").alias("matched"), F.col("e.start").cast("long").alias("start_at"), F.round(F.col("e.confidence").cast("double"), 4).alias("confidence"))


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and bytes of each document: every byte is in exactly one piece."""

    @F.pandas_udf("struct<n_pieces:bigint,n_bytes:bigint,n_merged:bigint>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = small_bpe()
        for s in batches:
            # as many texts at a time as have about so many characters
            size = s.str.len().fillna(0).cumsum().to_numpy(float) // COUNTED
            parts = [bpe.counted(list(g)) for g in np.split(s.to_numpy(object), np.flatnonzero(np.diff(size)) + 1)]
            yield pd.DataFrame(np.concatenate(parts), columns=["n_pieces", "n_bytes", "n_merged"])

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", count("text").alias("c"))
    return d.select("doc_id", "c.n_pieces", "c.n_bytes", "c.n_merged")


def _path_sql() -> str:
    """Best paths as SQL, a step of all sequences for each token: p (seq_id, t, class) and names."""
    names = D.class_names()
    step = D.transitions(names)
    allowed = ", ".join(f"({a}, {b})" for a in range(len(names)) for b in range(len(names)) if step[a, b] == 0)
    starts = ", ".join(str(i) for i, n in enumerate(names) if n[0] in "OBS")
    sql = f"""
WITH e AS (SELECT vec_id // {ROW} AS seq_id, row_number() OVER (PARTITION BY vec_id // {ROW} ORDER BY vec_id) - 1 AS t, CAST(embedding[1:{N_CLASSES}] AS FLOAT[]) AS x FROM embeddings),
l AS MATERIALIZED (SELECT seq_id, t, i - 1 AS c, x[i] AS v FROM (SELECT *, unnest(range(1, {N_CLASSES + 1})) AS i FROM e)),
k(a, c) AS (VALUES {allowed}),
names(c, edge, type) AS (VALUES {", ".join(f"({i}, '{n[0]}', '{n[2:]}')" for i, n in enumerate(names))}),
s0 AS MATERIALIZED (SELECT seq_id, c, v AS score, [c] AS path FROM l WHERE t = 0 AND c IN ({starts}))"""
    for t in range(1, ROW):  # of equal scores the lowest class before
        sql += f""",
s{t} AS MATERIALIZED (SELECT seq_id, c, b.score, list_append(b.path, c) AS path FROM (
  SELECT s.seq_id, l.c, max({{'score': CAST(s.score + l.v AS FLOAT), 'before': -s.c, 'path': s.path}}) AS b FROM s{t - 1} AS s JOIN k ON k.a = s.c JOIN l ON l.seq_id = s.seq_id AND l.c = k.c AND l.t = {t} GROUP BY s.seq_id, l.c))"""
    every = " UNION ALL ".join(f"SELECT seq_id, {t} AS t, c, score, path FROM s{t}" for t in range(ROW))
    return sql + f""",
b AS (SELECT seq_id, max({{'t': t, 'score': score, 'c': -c, 'path': path}}).path AS path FROM ({every}) GROUP BY seq_id),
p AS (SELECT seq_id, unnest(range(0, len(path))) AS t, unnest(path) AS c FROM b)"""


def _bpe_sql() -> str:
    """The merges one after another: none makes a pair of lower rank. Only one pair is of two bytes of one character."""
    text = "regexp_replace(text, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g')"
    for a, b in (m for m in MERGES if m != ("Ã", "©")):
        a, b = a.replace("Ġ", " "), b.replace("Ġ", " ")
        text = f"replace({text}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a + b}' || chr(2))"
    return f"""
WITH m AS (SELECT doc_id, text, {text} AS r, length(text) - length(replace(text, 'é', '')) AS e FROM documents)
SELECT doc_id, CAST(length(r) - length(replace(r, chr(2), '')) + strlen(text) - length(text) - e AS BIGINT) AS n_pieces, CAST(strlen(text) AS BIGINT) AS n_bytes,
       CAST(len(regexp_extract_all(r, chr(1) || '[^' || chr(2) || ']{{2,}}' || chr(2))) + e AS BIGINT) AS n_merged FROM m"""


SQL = {
    "bpe_encode": _bpe_sql(),
    "viterbi_decode": _path_sql() + " SELECT seq_id, t AS token, CAST(c AS BIGINT) AS class FROM p",
    "bioes_entities": _path_sql() + f""",
q AS (SELECT l.seq_id, l.t, CAST(exp(CAST(max(v) FILTER (WHERE l.c = p.c) AS DOUBLE) - max(v)) / sum(exp(CAST(v AS DOUBLE) - m)) AS DOUBLE) AS prob, any_value(p.c) AS c
      FROM (SELECT *, max(v) OVER (PARTITION BY seq_id, t) AS m FROM l) AS l JOIN p ON p.seq_id = l.seq_id AND p.t = l.t GROUP BY l.seq_id, l.t),
n AS (SELECT q.*, edge, type, sum(CASE WHEN edge IN ('B', 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY t) AS entity FROM q JOIN names USING (c))
SELECT seq_id, type, substr('{" ".join("abcdefghij")}', CAST(2 * min(t) + 1 AS BIGINT), CAST(2 * (max(t) - min(t)) + 1 AS BIGINT)) AS matched, 2 * min(t) AS start_at, round(avg(prob), 4) AS confidence
FROM n WHERE edge <> 'O' GROUP BY seq_id, type, entity""",
    "softmax_assigned_prob": """
WITH e AS (SELECT vec_id, embedding AS x FROM embeddings), m AS (SELECT *, list_max(x) AS top FROM e)
SELECT vec_id, CAST(list_position(x, top) - 1 AS BIGINT) AS class, round(1 / list_sum(list_transform(x, lambda v: exp(v::DOUBLE - top::DOUBLE))), 6) AS prob FROM m""",
}
QUERIES = {f.__name__: f for f in (softmax_assigned_prob, viterbi_decode, bioes_entities, bpe_encode)}
