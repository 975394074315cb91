"""Near-duplicates by a signature-coordinate inverted join, confirmed on full sets.

A document is the set of its distinct word shingles. Equal sets are one class
with one representative. A representative has a MinHash signature of ``K``
coordinates and is posted under its (coordinate, value) keys. Two sets at
similarity 0.8 share each key with that chance, so fewer than ``T`` of ``K``
matches has a chance below 1e-4 at exactly 0.8 and next to none above 0.85.

Prefix: pairs with T matches share at least one of the K - T + 1 rarest keys of
either, so only those are joined. Keys of a passage that many documents quote
are frequent and stay outside the prefixes, and a document with that many keys
of its own is skipped altogether.

Links are sought in two steps, neither of which forms the pairs of a group:

1. Stars. Each key has a leader, the document that shares most keys. A document
   is confirmed against the leader that it meets most often; links give first
   components.
2. What is left. Only keys that still hold several components matter. The
   shingles that no other such document has are counted, and give an upper bound
   of a document's similarity to any partner and, with sizes, of a pair's: pairs
   of different components that pass it are confirmed and linked. Nothing that
   can be a link between components is skipped.

A pair is confirmed if T keys match and the exact similarity of the full shingle
sets reaches the limit.

Cases: null and empty texts, and those without words, are linked with nothing;
rows with the same id are one document of several texts; null ids are linked
with nothing and have no component; an empty table gives an empty result; the
stage keeps columns of any name, also twice the same.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import Positions, small_batches, table
from maskweave.llm.files import releasing
from maskweave.llm.graph import components
from maskweave.llm.shingles import MinHash, shingle_sets
from maskweave.storage import collected, compacted, delete, few, in_few_files, stage

K, T = 64, 38
SIMILAR = 80  # percent
#: A key with more than one in HOT_KEYS of the shared postings (so there are fewer than that) is dealt over SPLIT tasks.
HOT_KEYS, SPLIT = 400, 32


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *arrays]))


def _batches(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without words or id), keys. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(K)
        for batch in (b for whole in batches for b in _batches(whole)):
            counts, digests, keys = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                counts.append(len(s))
                held = len(s) and i is not None
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if held else None)
                keys.append(hasher.keys(s) if held else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), _lists(keys)], names=["doc_id", "n_shingles", "digest", "keys"])

    with small_batches(docs.sparkSession):
        return compacted(docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n_shingles long, digest binary, keys array<long>"), "signatures")


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(rep, leader, text) with ``shingles`` and ``keys`` in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(K)
        for batch in (b for whole in batches for b in _batches(whole)):
            sets = list(shingle_sets(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([s.view(np.int64) for s in sets]), _lists([hasher.keys(s) for s in sets])], names=["rep", "leader", "shingles", "keys"])

    return docs.mapInArrow(releasing(run), "rep long, leader long, shingles array<long>, keys array<long>")


def _often(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, df) of the keys that are shared, by a map-side count, and those of them that are hot: fewer than HOT_KEYS."""
    often = compacted(posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    total = often.agg(F.sum("df")).first()[0] or 0
    return often, F.broadcast(often.where(F.col("df") * HOT_KEYS > total).select("key", F.lit(True).alias("hot")))


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings with ``salt``: those of a hot key get one by their document."""
    return rows.join(hot, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SPLIT))).otherwise(F.lit(0).cast("long"))).drop("hot")


def _copied(side: DataFrame, hot: DataFrame) -> DataFrame:
    """What is to meet them: a row for each salt of its key."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return side.join(hot, "key", "left").withColumn("salt", F.explode(salts)).drop("hot")


def _by_key(rows: DataFrame, side: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings joined on their key with a side of a row for each key."""
    return _dealt(rows, hot).join(_copied(side, hot), ["key", "salt"]).drop("salt")


def prefixes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, shared, key) for the keys that others share within each prefix of rarest keys; and the hot keys.

    The list that is sorted is one document's keys, K at most."""
    posts = reps.select("rep", "n_shingles", F.explode("keys").alias("key"))
    often, hot = _often(posts)
    mine = _by_key(posts, often, hot).groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ks"))
    # keys that nobody shares are the rarest: they use up the prefix first
    room = F.lit(K - T + 1) - (F.lit(K) - F.size("ks"))
    cut = mine.where(room > 0).select("rep", F.col("n_shingles").alias("n"), F.size("ks").alias("shared"), F.explode(F.slice("ks", 1, room)).alias("x"))
    return compacted(cut.select("rep", "n", "shared", F.col("x.key").alias("key")), "prefixes"), hot


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets (sa, sb) and of what they share; ``linked`` if that
    is enough and their keys (ka, kb) match often enough."""
    out = pairs.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size(F.array_intersect("ka", "kb")) >= T).alias("meets"))
    return out.withColumn("linked", F.col("meets") & (100 * F.col("both") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("both")))).drop("meets")


def _stars(prefix: DataFrame, hot: DataFrame) -> DataFrame:
    """(rep, leader): the leader that each document meets in most of its prefix keys."""
    best = F.max(F.struct("shared", (-F.col("rep")).alias("neg"))).alias("m")
    leaders = prefix.groupBy("key").agg(best, F.count(F.lit(1)).alias("held")).where("held > 1").select("key", (-F.col("m.neg")).alias("leader"))
    met = _by_key(prefix, leaders, hot).where("rep <> leader").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("hits"))
    most = F.max(F.struct("hits", (-F.col("leader")).alias("neg"))).alias("m")
    return compacted(met.groupBy("rep").agg(most).select("rep", (-F.col("m.neg")).alias("leader")), "stars")


def _mixed(posts: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings of the keys that hold several components."""
    keys = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return _by_key(posts, keys, hot)


def _left_over(prefix: DataFrame, hot: DataFrame, sets: DataFrame, comps: DataFrame, star: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can still be similar.

    A document's own shingles, which no other one here has, can't be shared. With
    them two bounds hold, one from sizes alone, and one for documents of the same
    leader: of what either misses of the leader, and of what either has besides, the
    smaller amount at most is common to both, and all else differs."""
    posts = prefix.select("rep", "key").join(comps.select(F.col("node").alias("rep"), F.col("component").alias("found")), "rep", "left")
    posts = compacted(_mixed(posts.select("rep", "key", F.coalesce("found", "rep").alias("comp")), hot), "mixed")
    reps = posts.select("rep").distinct()
    here = reps.unionByName(star.join(reps.withColumnRenamed("rep", "a"), "a").select(F.col("b").alias("rep"))).distinct()
    texts = compacted(sets.select("rep", "shingles").join(here, "rep").select("rep", "shingles"), "left-over")
    alone = texts.select("rep", F.explode("shingles").alias("s")).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).where("n = 1")
    alone = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    bound = texts.groupBy("rep").agg(F.min(F.size("shingles")).alias("lo"), F.max(F.size("shingles")).alias("hi"), F.count(F.lit(1)).alias("n_texts"))
    # a document of several texts counts with what its texts allow together, and with no leader
    single = F.col("n_texts") == 1
    bound = bound.join(alone, "rep", "left").select("rep", "lo", "hi", F.when(single, F.coalesce("own", F.lit(0))).otherwise(0).alias("own"), single.alias("single"))
    bound = compacted(bound, "bounds")
    lead = star.join(bound.where("single").select(F.col("rep").alias("b")), "b", "left_semi").select(F.col("a").alias("rep"), F.col("b").alias("leader"), (F.col("nb") - F.col("both")).alias("less"), (F.col("na") - F.col("both")).alias("more"))
    bound = bound.join(lead.dropDuplicates(["rep"]), "rep", "left").withColumn("leader", F.when(F.col("single"), F.col("leader"))).drop("single")
    able = bound.where(100 * (F.col("hi") - F.col("own")) >= SIMILAR * F.col("lo"))
    posts = _mixed(posts.join(able, "rep"), hot)
    keys = posts.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # of a prefix: a bounded list
    posts = compacted(posts.join(keys, "rep"), "able")
    columns = ("rep", "comp", "lo", "hi", "own", "leader", "less", "more", "keys")
    # the one join whose sides both have many rows for a key: Spark splits its large partitions
    x = posts.select("key", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = posts.select(F.col("key").alias("y_key"), *[F.col(c).alias(f"y_{c}") for c in columns])
    c = F.col
    shared = F.least(c("x_hi") - c("x_own"), c("y_hi") - c("y_own"))
    union = F.greatest(c("x_lo") + c("y_own"), c("y_lo") + c("x_own"))
    by_size = 100 * shared >= SIMILAR * union
    apart = F.abs(c("x_less") - c("y_less")) + c("x_more") + c("y_more") - 2 * F.least(c("x_more") - c("x_own"), c("y_more") - c("y_own"))
    by_leader = F.coalesce((c("x_leader") != c("y_leader")) | ((100 + SIMILAR) * apart <= (100 - SIMILAR) * (c("x_hi") + c("y_hi"))), F.lit(True))
    tried = F.coalesce((c("x_leader") == c("y_rep")) | (c("y_leader") == c("x_rep")), F.lit(False))
    once = c("key") == F.array_min(F.array_intersect("x_keys", "y_keys"))  # a pair comes from the least of its keys alone
    can = (c("key") == c("y_key")) & (c("x_rep") < c("y_rep")) & (c("x_comp") != c("y_comp")) & by_size & by_leader & ~tried & once
    return x.join(y, can).select(c("x_rep").alias("a"), c("y_rep").alias("b")).distinct()


def links(docs: DataFrame, sigs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) between representatives, enough to connect all that is linked."""
    on = [F.col("digest") == F.col("of"), F.col("doc_id") == F.col("rep")]
    reps = sigs.join(classes.withColumnRenamed("digest", "of").select("of", "rep"), on).dropDuplicates(["rep", "digest"])
    prefix, hot = prefixes(reps.select("rep", "n_shingles", "keys"))
    star = _stars(prefix, hot)
    # the sets of the documents that share a prefix key, made again from their texts
    wanted = compacted(prefix.select("rep").distinct().join(star, "rep", "left"), "wanted")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(few(wanted, 16), "rep")
    with small_batches(docs.sparkSession):
        sets = compacted(shingle_table(texts.select("rep", "leader", "text"), width), "sets")
    head = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), F.col("keys").alias("kb"))
    head = head.join(few(compacted(star.select(F.col("leader").alias("b")).distinct(), "leaders"), 8), "b", "left_semi")
    one = sets.where("leader is not null").select(F.col("rep").alias("a"), F.col("leader").alias("b"), F.col("shingles").alias("sa"), F.col("keys").alias("ka"))
    tried = compacted(_measured(one.join(head, "b")), "star-pairs")
    found = tried.where("linked").select("a", "b")
    pairs = compacted(_left_over(prefix, hot, sets, components(found), tried), "pairs")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"), F.col("keys").alias("ka"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), F.col("keys").alias("kb"))
    ends = compacted(pairs.select(F.col("a").alias("b")).union(pairs.select("b")).distinct(), "ends")
    right = right.join(few(ends, 8), "b", "left_semi")
    left = left.join(pairs, "a")
    return found.unionByName(_measured(left.join(right, "b")).where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """A row (doc_id, n_shingles, component_id, kept) for each of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = signatures(docs, width)
    classes = compacted(sigs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # a document of several texts ties their classes together
    ties = sigs.where("digest is not null").select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep")
    several = sigs.where("digest is not null").groupBy("doc_id").agg(F.countDistinct("digest").alias("n")).where("n > 1").select("doc_id")
    ties = ties.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    with collected() as scratch:
        found = components(links(docs, sigs, classes, width).unionByName(ties))
    comps = compacted(found, "components")
    delete(docs.sparkSession, scratch)
    rows = sigs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    rows = rows.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = rows.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, kept) by 5-word shingles, written; all other tables are gone."""
    with collected() as scratch:
        found = near_duplicates(docs, width=5).select("doc_id", "kept")
    out = compacted(found, "near-dups")
    delete(docs.sparkSession, scratch)
    return out


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, by 5-word shingles at 0.8; of an id with dissimilar texts, one row of each."""
    held_docs = Positions(docs)
    rows, doc_id, text = held_docs.rows, held_docs["doc_id"], held_docs["text"]
    found = _judged(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    gone = compacted(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    out = rows.join(few(gone, 8), F.col(doc_id) == F.col("gone"), "left_anti")
    again = compacted(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "again")
    if not again.count():
        return in_few_files(held_docs.back(out))
    # where a kept id repeats, its texts are told apart: one row of each group of them stays
    once = out.join(few(again, 8), F.col(doc_id) == F.col("again"), "left_anti")
    rest = out.join(few(again, 8), F.col(doc_id) == F.col("again"), "left_semi").withColumn("order", F.to_json(F.struct(*held_docs.inner)))
    equal = W.partitionBy(doc_id, F.sha1(F.col(text).cast("binary"))).orderBy("order")
    rest = rest.withColumn("place", F.row_number().over(equal)).where("place = 1").drop("place")
    rest = stage(rest.orderBy(doc_id, "order").withColumn("near_id", F.monotonically_increasing_id()), "repeated-ids")
    kept = _judged(rest.select(F.col("near_id").alias("doc_id"), F.col(text).alias("text"))).where("kept").select(F.col("doc_id").alias("near_id"))
    return held_docs.back(once.unionByName(rest.join(kept, "near_id", "left_semi").select(*held_docs.inner)))


SQL = {
    "op10_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w
), e AS (
  SELECT doc_id, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e AS a JOIN e AS b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN s AS sa ON sa.doc_id = a JOIN s AS sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.g) + len(sb.g) - n)
), r(id, dest) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.dest = l.a
), c AS (
  SELECT id, min(dest) AS component_id FROM r GROUP BY id
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id
""",
}
QUERIES = {"op10_near_duplicates": op10_near_duplicates}
