"""Mixing sources to target weights, by blocks of words.

The words of a source, document after document, are packed into blocks of
``BLOCK`` words. The mix is a row of slots, cut into output shards of
``SHARD_SLOTS``. Each slot of a shard draws a source with the targets as
weights, so a shard's source counts are a multinomial draw (by hash, so reruns
agree). Drawn totals stray from their targets by about the square root of the
slots; the slots that a source has drawn beyond its target, picked by a
permutation, go to the sources that lack some, so totals end at their targets
(to half a block) and all other draws stay.

A source's slots are numbered through its shards. Slot q takes block p(q mod N)
of the source's N blocks, where p is a pseudorandom permutation for each pass
q div N over the source, so no block is taken twice before all have been. Blocks
are joined to documents by index.

The permutation is swap-or-not (Hoang, Morris and Rogaway, 2012), which needs no
table and no sort and works for any number of slots.

A source's running word count is taken in two levels (within and over about
sqrt(rows) hashed buckets), so a source with a third of all rows is no one
task's. Everything is JVM side.

Cases: a null text has no words; null sources are one source, the last; a
source without words has target 0; documents without words are never taken;
rows with the same id are packed each; an empty table gives an empty mix; the
pipeline's stage keeps columns of any name, also twice the same.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import Positions, let, table, words
from maskweave.storage import collected, compacted, delete, few, handed_on, in_few_files, stage

BLOCK, SHARD_SLOTS, MAX_REPEATS, SEED = 64, 16384, 3, 20240229
ROUNDS = 20
#: Cells of equal width over all targets; a cell holds the sources that reach into it.
CELLS = 4096


def shuffled(x: Column, n: Column, *key: Column | int) -> Column:
    """Place of x under a pseudorandom permutation of 0 .. n-1 that ``key`` names."""
    key = [k if isinstance(k, Column) else F.lit(k) for k in key]

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        swap = F.xxhash64(F.lit(SEED + 1), r, F.greatest(at, other), *key).bitwiseAND(F.lit(1)) == 1
        return let(other, lambda o: F.when(swap, o).otherwise(at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def measured(docs: DataFrame, *keep: str, text: str = "text", source: str = "source") -> DataFrame:
    """The columns ``keep`` of each document with its size, source key and a tie-breaking hash."""
    return docs.select(
        *keep,
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source))).alias("key"),
        F.xxhash64(text).alias("h"),
    )


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source: source_size, target, n_blocks, n_slots, first_slot, all_slots.

    Weights are 1, 2, 3 by turns over the sources in code point order, null
    last. Shares above MAX_REPEATS times a source's size stop there and the rest
    is shared again: sorted by cap over weight, the capped sources come first,
    and the water level of the others follows from running sums. These windows
    run over one row for each source."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy((F.col("key") == "n"), "key"))
    per = per.withColumns({"weight": ((rank - 1) % 3 + 1).cast("double"), "cap": MAX_REPEATS * F.col("source_size")})
    by_cap = one.orderBy(F.col("cap") / F.col("weight"), "key")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumns({"level": rest / weights, "place": F.row_number().over(by_cap)})
    per = per.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(one)["level"]
    per = per.withColumn("target", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double")))
    per = per.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("n_slots", F.least(slots, MAX_REPEATS * F.col("n_blocks")))
    first = F.coalesce(F.sum("n_slots").over(one.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return per.withColumns({"first_slot": first, "all_slots": F.sum("n_slots").over(one)}).select("key", "source_size", "target", "n_blocks", "n_slots", "first_slot", "all_slots")


def packed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``: the words of the source before the document."""
    n_buckets = max(1, round(sizes.count() ** 0.5))
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_buckets)))
    within = W.partitionBy("key", "bucket").orderBy("doc_id", "h", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    over = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_buckets))).groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.select("key", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))
    return rows.join(totals, ["key", "bucket"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset", "bucket")


def draws(sources: DataFrame) -> DataFrame:
    """(shard, key, n): the slots of each shard that draw each source."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    last = F.lit(max(1, total)).cast("long")
    cell = lambda at: F.expr(f"({at} * {CELLS}L) div {max(1, total)}L").cast("int")
    held = sources.where("n_slots > 0").select("key", F.col("first_slot").alias("lo"), (F.col("first_slot") + F.col("n_slots")).alias("hi"))
    cells = compacted(held.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("(hi - 1)")))), "mix-cells")
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 22)
    slot = spark.range(0, total, 1, n_tasks).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), last).alias("u")).withColumn("cell", cell("u"))
    drawn = slot.join(few(cells), "cell").where("u >= lo AND u < hi")
    return compacted(drawn.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")), "mix-draws")


def slots(sources: DataFrame) -> DataFrame:
    """The mix: (shard, key, pass, block) for each slot."""
    drawn = draws(sources)
    earlier = W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = compacted(sources.join(drawn.groupBy("key").agg(F.sum("n").alias("drawn")), "key", "left").select("key", "n_blocks", "n_slots", F.coalesce("drawn", F.lit(0).cast("long")).alias("drawn")), "mix-totals")
    # a few rows become many here, so their number of tasks is given: it would be taken from the size of the few
    n_tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = runs.join(few(totals), "key").repartition(n_tasks, "key", "shard").withColumn("k", F.explode(F.expr("sequence(first, first + n - 1)")))
    q = F.when(F.col("drawn") > F.col("n_slots"), shuffled(F.col("k"), F.col("drawn"), 3, F.col("key"))).otherwise(F.col("k"))
    each = stage(each.select("shard", "key", q.alias("q")), "mix-slots")
    # what one source has drawn too often goes to those that lack it: about the root of all slots
    numbered = lambda df, *by: df.withColumn("e", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by)))
    own = each.join(few(totals), "key")
    over = numbered(own.where("q >= n_slots"), "shard", "key", "q").select("shard", "e")
    lack = totals.where("n_slots > drawn").withColumn("q", F.explode(F.expr("sequence(drawn, n_slots - 1)")))
    lack = numbered(lack, F.xxhash64("key", "q"), "key", "q")
    columns = ("shard", "key", "q", "n_blocks")
    out = own.where("q < n_slots").select(*columns).unionByName(over.join(lack, "e").select(*columns))
    turn = F.expr("q div n_blocks")
    return out.select("shard", "key", turn.alias("pass"), shuffled(F.col("q") % F.col("n_blocks"), F.col("n_blocks"), F.col("key"), turn).alias("block"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block that share words: the first word and number of words within the document."""
    held = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return held.withColumns({"first_word": lo - F.col("start"), "n_taken": hi - lo})


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the words that the mix takes of it, and how many of them each shard drew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = stage(measured(docs, "doc_id"), "mix-sizes")
    sources = compacted(targets(sizes), "mix-sources")
    drawn = slots(sources).groupBy("key", "block").agg(F.collect_list("shard").alias("shards"))
    rows = packed(sizes)
    # slots come from a few rows, whose size says nothing of theirs: never broadcast them
    taken = pieces(rows).join(drawn.hint("merge"), ["key", "block"], "left").withColumn("shard", F.explode_outer("shards"))
    document = ("doc_id", "key", "size", "start")
    taken = taken.groupBy(*document, "shard").agg(F.sum(F.when(F.col("shard").isNull(), 0).otherwise(F.col("n_taken"))).alias("words"))
    held = F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "words")))
    taken = taken.groupBy(*document).agg(F.sum("words").alias("taken"), F.array_sort(held).alias("shards")).drop("start")
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    out = taken.unionByName(rows.where("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"), none.alias("shards")))
    out = out.join(few(sources.select("key", "source_size", "target")), "key")
    source = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30))
    return out.select("doc_id", "size", "source_size", "target", "taken", source.alias("source"), "shards")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: a row for each output shard and document, with the words
    that the shard drew of it, by passes, joined by spaces; one that drew all of a
    document once has its text as it is."""
    given = Positions(docs)
    doc_id, text = given["doc_id"], given["text"]
    held = stage(given.rows.withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    with collected() as scratch:
        sizes = stage(measured(held, "row", F.col(doc_id).alias("doc_id"), text=text, source=given["source"]), "mix-sizes")
        drawn = slots(compacted(targets(sizes), "mix-sources"))
        parts = pieces(packed(sizes)).join(drawn.hint("merge"), ["key", "block"])
        parts = parts.groupBy("row", "shard", "size").agg(F.array_sort(F.collect_list(F.struct("pass", "first_word", "n_taken"))).alias("parts"), F.sum("n_taken").alias("taken"), (F.min("pass") == F.max("pass")).alias("one_pass"))
        whole = (F.col("taken") == F.col("size")) & F.col("one_pass")
        picks = compacted(parts.groupBy("row").agg(F.collect_list(F.struct("shard", whole.alias("whole"), "parts")).alias("picks")), "mix-picks")
    delete(spark, scratch[:-1])
    handed_on(scratch[-1:])  # the picks are read with the result
    joined = held.join(picks, "row")

    def of(w: Column, pick: Column) -> Column:
        some = F.flatten(F.transform(pick["parts"], lambda p: F.slice(w, (p["first_word"] + 1).cast("int"), p["n_taken"].cast("int"))))
        return F.when(pick["whole"], F.col(text)).otherwise(F.array_join(some, " "))

    mixed = let(words(F.col(text)), lambda w: F.transform("picks", lambda p: of(w, p)))
    out = joined.withColumn("mixed", F.explode(mixed)).withColumn(text, F.col("mixed"))
    if "n_chars" in docs.columns:
        at = given["n_chars"]
        out = out.withColumn(at, F.length("mixed").cast(held.schema[at].dataType))
    return in_few_files(given.back(out))


QUERIES = {"op8_source_mix": op8_source_mix}
