"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words that a fixed mask picks from a window, so words
at its gaps may differ. Seeds of the training texts are held against those of
the benchmark, first by a bitmap with ``BITS`` bits for each of its seeds, then
by an exact join. The bitmap's words are rows, at most ``MAX_WORDS``, so they are
broadcast; a benchmark too large for that only passes more to the exact join.
Windows become rows within one generated loop, which ends in the bitmap's join. Around each hit, item and text are laid side by
side over ``WINDOW`` words of the item (or all of a shorter one), and the
overlap is verified if at least ``MATCH`` percent of the words agree.

Words are longest runs of letters and digits, lower-cased.

Cases: null and empty texts and items have no words; items shorter than a mask
are not searched; an item's words beyond the text's ends count as different;
rows with the same id and text are one document, those with the same id and
other texts are judged each; an empty table or benchmark finds nothing; the
stage keeps columns of any name, also twice the same. Everything is JVM side.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import Positions, let, table, upto
from maskweave.storage import compacted, few, in_few_files

MASKS = ("11011001", "10101011", "11100101")
SPAN = len(MASKS[0])
WINDOW, MATCH = 20, 80
#: Bits of a place within a stretch of a text, whose hits are one row.
STRETCH = 16
#: Bits of the bitmap for each seed, and the most 64-bit words that it has.
BITS, MAX_WORDS = 32, 1 << 19


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _seed(h: Column, i: Column, m: int) -> Column:
    return F.xxhash64(F.lit(m), *[F.get(h, i + o) for o, c in enumerate(MASKS[m]) if c == "1"])


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(h: Column) -> Column:
    return upto(F.size(h) - (SPAN - 1))


def item_seeds(items: DataFrame) -> DataFrame:
    """(mask, seed, item_key, at) of ``items`` (item_key, words)."""
    def of(h: Column, m: int) -> Column:
        return F.transform(_starts(h), lambda i: F.struct(F.lit(m).alias("mask"), _seed(h, i, m).alias("seed"), i.alias("at")))

    each = let(_hashes(F.col("words")), lambda h: F.flatten(F.array(*[of(h, m) for m in range(len(MASKS))])))
    return items.select("item_key", F.explode(each).alias("s")).select("s.mask", "s.seed", "item_key", F.col("s.at").alias("item_at"))


def item_windows(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """(mask, seed, item_key, first, width, shift): the window of its item around each seed, and where the seed is in it.

    Windows of equal words are the first of them, so an item that repeats itself has as many rows
    of a seed as there are different windows and places, however often it holds the seed."""
    near = F.least(F.greatest(F.col("item_at") - F.floor((F.col("width") - SPAN) / 2), F.lit(0)), F.size("words") - F.col("width")).cast("int")
    rows = seeds.join(few(items), "item_key").withColumn("width", F.least(F.lit(WINDOW), F.size("words"))).withColumn("near", near)
    rows = rows.withColumn("first", F.min("near").over(W.partitionBy("item_key", F.slice("words", F.col("near") + 1, F.col("width")))))
    return rows.select("mask", "seed", "item_key", "first", "width", (F.col("item_at") - F.col("near")).alias("shift")).distinct()


def bitmap(seeds: DataFrame) -> tuple[DataFrame, int]:
    """Rows (word, bits) of the bitmap's words that aren't zero, and the number of words, a power of two."""
    n_words, n = 64, seeds.count()
    while n_words < MAX_WORDS and 64 * n_words < BITS * n:
        n_words *= 2
    word, bit = _place(F.col("seed"), n_words)
    return compacted(seeds.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "bitmap"), n_words


def _place(seed: Column, n_words: int) -> tuple[Column, Column]:
    """The word and the bit of a seed."""
    return F.shiftrightunsigned(seed, 6).bitwiseAND(F.lit(n_words - 1).cast("long")).cast("int"), seed.bitwiseAND(F.lit(63).cast("long")).cast("int")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: (doc_id, text_hash, item_id, matched, compared), the best for each text and item."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), text_words(F.col(item_text)).alias("words")).where(F.size("words") >= SPAN).distinct()
    items = compacted(items.withColumn("item_key", F.xxhash64("item_id", "words")).select("item_key", "item_id", "words"), "items")
    seeds = compacted(item_windows(item_seeds(items), items), "item-seeds")
    words, n_words = bitmap(seeds)
    at = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashes(text_words(F.col("text"))).alias("h"))
    at = at.select("doc_id", "text_hash", "h", F.explode(_starts(F.col("h"))).alias("at"))
    each = F.array(*[F.struct(F.lit(m).alias("mask"), _seed(F.col("h"), F.col("at"), m).alias("seed")) for m in range(len(MASKS))])
    hits = at.select("doc_id", "text_hash", "at", F.explode(each).alias("s")).select("doc_id", "text_hash", "at", "s.mask", "s.seed")
    word, bit = _place(F.col("seed"), n_words)
    hits = hits.withColumn("word", word).join(F.broadcast(words), "word").where(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).drop("word", "bits")
    hits = hits.join(few(seeds), ["mask", "seed"])
    # a stretch of places at a time, so a text that hits everywhere is several rows
    begin = F.col("at") - F.col("shift")
    spots = hits.select("doc_id", "text_hash", F.shiftright(begin, STRETCH).alias("stretch"), F.struct("item_key", "first", begin.alias("begin"), "width").alias("spot"))
    spots = compacted(spots.groupBy("doc_id", "text_hash", "stretch").agg(F.collect_set("spot").alias("spots")).drop("stretch"), "spots")
    # the texts with hits once more, cut to the windows
    side = spots.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    held = docs.join(few(side), at)
    cut = let(
        text_words(F.col("text")),
        lambda w: F.transform("spots", lambda s: F.struct(s["item_key"].alias("item_key"), s["first"].alias("first"), F.transform(upto(s["width"]), lambda k: F.get(w, s["begin"] + k)).alias("part"))),
    )
    cuts = held.select("doc_id", F.col("_hash").alias("text_hash"), F.explode(cut).alias("c")).select("doc_id", "text_hash", "c.*")
    sides = cuts.join(few(items), "item_key")
    same = F.size(F.filter(F.zip_with(F.col("part"), F.slice("words", F.col("first") + 1, F.size("part")), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    checked = sides.select("doc_id", "text_hash", "item_id", same.cast("long").alias("matched"), F.size("part").cast("long").alias("compared"))
    best = F.max(F.struct("matched", "compared")).alias("b")
    return checked.where(100 * F.col("matched") >= MATCH * F.col("compared")).groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.matched", "b.compared")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items that they hold."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "compared")).alias("b")).select("doc_id", "item_id", "b.matched", "b.compared")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap."""
    held = Positions(docs)
    doc_id, text = F.col(held["doc_id"]), F.col(held["text"])
    found = overlaps(held.rows, table(spark, sf_dir, "benchmark"), held["doc_id"], held["text"])
    bad = compacted(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    return in_few_files(held.back(held.rows.join(few(bad, 16), doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left_anti")))


_SQL_SEEDS = " UNION ALL ".join(
    f"SELECT {{0}}, {m} AS mask, i, [" + ", ".join(f"ws[i + {o}]" for o, c in enumerate(mask) if c == "1") + f"] AS seed FROM (SELECT *, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM {{1}})" for m, mask in enumerate(MASKS)
)
SQL = {
    "op1_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT DISTINCT item_id, ws FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) >= {SPAN}
), ds AS ({_SQL_SEEDS.format("rid", "d")}
), bs AS ({_SQL_SEEDS.format("item_id, ws", "b")}
), h AS (
  SELECT DISTINCT ds.rid, bs.item_id, bs.ws, least({WINDOW}, len(bs.ws)) AS width, ds.i - bs.i AS off,
         least(greatest(bs.i - 1 - (least({WINDOW}, len(bs.ws)) - {SPAN}) // 2, 0), len(bs.ws) - least({WINDOW}, len(bs.ws))) AS first
  FROM ds JOIN bs USING (mask, seed)
), v AS (
  SELECT d.doc_id, h.item_id, CAST(width AS BIGINT) AS compared,
         CAST(len(list_filter(range(1, width + 1), lambda k: off + first + k >= 1 AND coalesce(d.ws[off + first + k] = h.ws[first + k], false))) AS BIGINT) AS matched
  FROM h JOIN d USING (rid)
), m AS (
  SELECT doc_id, item_id, max({{'m': matched, 'c': compared}}) AS x FROM v WHERE 100 * matched >= {MATCH} * compared GROUP BY ALL
)
SELECT doc_id, item_id, x.m AS matched, x.c AS compared FROM m
""",
}
QUERIES = {"op1_decontaminate": op1_decontaminate}
