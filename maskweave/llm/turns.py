"""Conversations put together from turns that come late, twice and out of order.

A streaming query groups turns by a hash bucket of their conversation. A bucket's
state is two columnar tables, kept as Arrow streams compressed with zstd: its
conversations, and the kept turns that wait for an earlier one. Each batch brings
a bucket its turns and one tick row, so silence is noticed without timers; both
are merged with the state by numpy over all conversations of the bucket at once.

Of a turn the earliest arrival is kept, and of a batch's arrivals the smallest
payload. A batch releases the gapless run of kept turns from the conversation's
first one. A conversation closes with the third batch in a row that brings
nothing of it, or at the end; what arrives after that is rejected.

*Long conversations.* A conversation's turns are dealt to buckets by stretches of
``2 ** SHIFT`` turn numbers, so no bucket holds more of it than a stretch. Each
stretch releases its own gapless run and learns by signs of life, one row for
each batch and stretch, when turns came elsewhere. What depends on other
stretches is put right by ``across_stretches`` from one closing row of each: a run
counts from the batch in which the last stretch before it was complete.

Rows of the stream: batch, bucket, kind (turn, life, tick, end), conv, part, split,
start (the stretch's first turn), room (its length), turn, role, text.

Cases: null turns are dropped by ``prepare``; null roles and texts are empty, a
null conversation id is one conversation of its own; equal rows arrive once; of
equal payloads with different roles the smaller role is kept; turns below the
first that their row names are not kept; an empty table gives no events; other
columns, of whatever names, are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from maskweave.llm.common import table
from maskweave.storage import delete, fresh_path, in_few_files

TURN, LIFE, TICK, END = range(4)
#: Bits of a turn number within a stretch; successive silent batches that close; turns for each bucket.
SHIFT, SILENT, BUCKET_ROWS = 14, 3, 4096
BATCHES = 8
FED = "batch int, bucket int, kind int, conv string, part long, split boolean, start long, room long, turn long, role string, text string"
EVENTS = (
    "event string, conv string, turn long, batch int, role string, text string, waiting array<long>, n_missing long, n_breaks long, "
    "part long, split boolean, start long, run long, kept long, top long, done int, first_role string, last_role string"
)
STATE = "convs binary, waiting binary"
_NAMES = [c.split(" ")[0] for c in EVENTS.split(", ")]
_CONVS = {"conv": object, "part": np.int64, "split": bool, "start": np.int64, "room": np.int64, "run": np.int64, "kept": np.int64, "breaks": np.int64, "idle": np.int64, "closed": bool, "done": np.int64, "first_role": object, "last_role": object}
_WAITING = {"at": np.int64, "turn": np.int64, "role": object, "text": object}
_ARROW = {object: pa.string(), np.int64: pa.int64(), bool: pa.bool_()}
Columns = dict[str, np.ndarray]


def pack(columns: Columns, kinds: dict) -> bytes:
    """Columns as an Arrow stream, compressed."""
    rows = pa.RecordBatch.from_arrays([pa.array(columns[c], _ARROW[k]) for c, k in kinds.items()], names=list(kinds))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes | None, kinds: dict) -> Columns:
    if data is None:
        return {c: np.empty(0, k) for c, k in kinds.items()}
    with pa.ipc.open_stream(data) as stream:
        rows = stream.read_all()
    return {c: rows[c].to_numpy().astype(k, copy=False) for c, k in kinds.items()}


def _added(columns: Columns, more: Columns) -> Columns:
    return {c: np.concatenate([x, more[c].astype(x.dtype, copy=False)]) for c, x in columns.items()}


def _taken(columns: Columns, rows: np.ndarray) -> Columns:
    return {c: x[rows] for c, x in columns.items()}


def _slots(convs: Columns, conv: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A number for each (conv, part): rows of ``convs`` keep theirs, new ones follow in order of appearance."""
    of_conv = pd.factorize(np.concatenate([convs["conv"], conv]))[0]
    of_part, parts = pd.factorize(np.concatenate([convs["part"], part]))
    return pd.factorize(of_conv.astype(np.int64) * len(parts) + of_part)[0]


def _smallest(slot: np.ndarray, rows: Columns) -> np.ndarray:
    """Row numbers in order of (slot, turn), one for each: that with the smallest payload, by bytes."""
    order = np.lexsort((rows["turn"], slot))
    again = (np.diff(slot[order]) == 0) & (np.diff(rows["turn"][order]) == 0)
    if not again.any():
        return order
    rank, several = np.zeros(len(slot), np.int64), np.append(again, False) | np.insert(again, 0, False)
    doubtful = order[several]
    by_payload = sorted(doubtful.tolist(), key=lambda i: (f"{rows['role'][i]}|{rows['text'][i]}".encode(), rows["role"][i]))
    rank[by_payload] = np.arange(len(by_payload))
    order = np.lexsort((rank, rows["turn"], slot))
    return order[np.insert((np.diff(slot[order]) != 0) | (np.diff(rows["turn"][order]) != 0), 0, True)]


def merge(convs: Columns, waiting: Columns, rows: Columns, batch: int) -> tuple[Columns, Columns, list[pd.DataFrame]]:
    """A bucket's next state and its events, from its state and the rows of a batch."""
    events: list[pd.DataFrame] = []
    told = _taken(rows, rows["kind"] <= LIFE)
    slot = _slots(convs, told["conv"], told["part"])[len(convs["conv"]) :]
    n_old = len(convs["conv"])
    new = np.unique(slot, return_index=True)
    new = new[1][new[0] >= n_old]
    n = len(new)
    opened = {c: told[c][new] for c in ("conv", "part", "split", "start", "room")}
    opened |= {c: np.zeros(n, np.int64) for c in ("run", "kept", "breaks", "idle")} | {"closed": np.zeros(n, bool), "done": np.full(n, -1), "first_role": np.full(n, None), "last_role": np.full(n, None)}
    convs = _added(convs, opened)
    n = len(convs["conv"])
    active = np.bincount(slot, minlength=n) > 0

    arrived = told["kind"] == TURN
    told, slot = _taken(told, arrived), slot[arrived]
    one = _smallest(slot, told)
    told, slot = _taken(told, one), slot[one]
    late = convs["closed"][slot]
    if late.any():
        events.append(_turns("reject", batch, convs, slot[late], _taken(told, late)))
    held = ~late & (told["turn"] - convs["start"][slot] >= convs["run"][slot])  # what is below was released

    # waiting turns first: of equal ones the first is kept
    both = _added(waiting, {"at": slot[held], **{c: told[c][held] for c in ("turn", "role", "text")}})
    order = np.lexsort((np.arange(len(both["at"])), both["turn"], both["at"]))
    both, is_new = _taken(both, order), order >= len(waiting["at"])
    at, turn, role = both["at"], both["turn"], both["role"]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 0) | (np.diff(turn) != 0)
    both, is_new = _taken(both, first), is_new[first]
    at, turn, role = both["at"], both["turn"], both["role"]
    convs["kept"] = convs["kept"] + np.bincount(at[is_new], minlength=n)

    # the gapless run: places and turn numbers go up together
    head = np.insert(np.diff(at) != 0, 0, True)[: len(at)]
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    free = turn - (convs["start"] + convs["run"])[at] == place
    same = np.zeros(len(at), bool)  # as the kept turn before it
    same[1:] = ~head[1:] & (np.diff(turn) == 1) & (role[1:] == role[:-1])
    joined = head & free & (convs["run"][at] > 0)
    same[joined] = role[joined] == convs["last_role"][at[joined]]
    if free.any():
        events.append(_turns("release", batch, convs, at[free], _taken(both, free)))
    convs["breaks"] = convs["breaks"] + np.bincount(at[free & same], minlength=n)
    begun = free & head & (convs["run"][at] == 0)
    convs["first_role"][at[begun]] = role[begun]
    convs["last_role"][at[free]] = role[free]  # the last of each one's rows stays
    was = convs["run"]
    convs["run"] = was + np.bincount(at[free], minlength=n)
    convs["done"] = np.where((convs["run"] > was) & (convs["run"] == convs["room"]), batch, convs["done"])
    waiting, same = _taken(both, ~free), same[~free]

    convs["idle"] = np.where(active, 0, convs["idle"] + 1)
    closing = ~convs["closed"] & ((convs["idle"] >= SILENT) | (rows["kind"] == END).any())
    if closing.any():
        events.append(_closed(batch, convs, closing, waiting, same))
        convs["closed"] = convs["closed"] | closing
        waiting = _taken(waiting, ~closing[waiting["at"]])
    return convs, waiting, events


def _turns(event: str, batch: int, convs: Columns, at: np.ndarray, rows: Columns) -> pd.DataFrame:
    out = pd.DataFrame({"event": event, "conv": convs["conv"][at], "turn": rows["turn"], "batch": batch, "role": rows["role"], "text": rows["text"], "part": convs["part"][at], "split": convs["split"][at]})
    none = {c: pd.Series(None, out.index, "Int64") for c in ("n_missing", "n_breaks", "start", "run", "kept", "top", "done")}
    none |= {c: pd.Series([None] * len(out), out.index, object) for c in ("waiting", "first_role", "last_role")}
    return out.assign(**none)[_NAMES]


def _closed(batch: int, convs: Columns, closing: np.ndarray, waiting: Columns, same: np.ndarray) -> pd.DataFrame:
    which = np.flatnonzero(closing)
    at, turn = waiting["at"], waiting["turn"]
    begin, end = np.searchsorted(at, which), np.searchsorted(at, which, side="right")
    c = _taken(convs, which)
    some = end > begin
    top = c["start"] + c["run"] - 1
    top[some] = turn[end[some] - 1]
    breaks = c["breaks"] + np.bincount(at[same], minlength=len(closing))[which]
    last = np.where(c["run"] == c["room"], c["last_role"], None)
    ends = some & (top == c["start"] + c["room"] - 1)
    last[ends] = waiting["role"][end[ends] - 1]
    out = pd.DataFrame({
        "event": "close", "conv": c["conv"], "turn": -1, "batch": batch, "role": None, "text": None, "waiting": [turn[a:b] for a, b in zip(begin, end)],
        "n_missing": top - c["start"] + 1 - c["kept"], "n_breaks": breaks, "part": c["part"], "split": c["split"], "start": c["start"], "run": c["run"], "kept": c["kept"], "top": top,
        "done": c["done"], "first_role": c["first_role"], "last_role": last,
    })
    return out[_NAMES]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frame = pd.concat(list(frames), ignore_index=True)
    rows = {c.split(" ")[0]: frame[c.split(" ")[0]].to_numpy() for c in FED.split(", ")}
    kept = state.get if state.exists else (None, None)
    convs, waiting, events = merge(unpack(kept[0], _CONVS), unpack(kept[1], _WAITING), rows, int(rows["batch"].max()))
    state.update((pack(convs, _CONVS), pack(waiting, _WAITING)))
    yield from events


def reassembled(stream: DataFrame) -> DataFrame:
    """The events of a stream of rows as ``FED`` names them, which brings every bucket a tick in each batch."""
    return stream.groupBy("bucket").applyInPandasWithState(_step, EVENTS, STATE, "append", "NoTimeout")


# -- what is fed -------------------------------------------------------------------


def prepare(arrivals: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Rows to feed, but for their bucket, from ``arrivals`` (conv, turn, role, text, batch).

    Equal turns of a batch meet before anything is dealt by conversation."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = arrivals.where("turn is not null").select(text("conv").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("batch").cast("int").alias("batch"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.groupBy("conv", "turn", "batch").agg(F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role")).alias("m"))
    bounds = arrivals.where("turn is not null").groupBy(text("conv").alias("_conv")).agg(F.min("turn").cast("long").alias("first"), F.max("turn").cast("long").alias("last"))
    rows = rows.join(bounds, F.col("conv") == F.col("_conv"))
    stretch = lambda c: F.shiftright(c, shift)
    part = stretch("turn") - stretch("first")
    start = F.greatest(F.shiftleft(stretch("turn"), shift), F.col("first"))
    room = F.col("start").bitwiseOR(F.lit((1 << shift) - 1)) - F.col("start") + 1
    out = rows.select("batch", F.lit(TURN).alias("kind"), "conv", part.alias("part"), (stretch("last") != stretch("first")).alias("split"), start.alias("start"), "turn", F.col("m.role").alias("role"), F.substr("m.payload", F.length("m.role") + 2).alias("text"))
    return out.withColumn("room", room)


def signs_of_life(prepared: DataFrame) -> DataFrame:
    """For each batch that brings a split conversation something, a row for each of its stretches."""
    split = prepared.where("split")
    when = split.select("conv", "batch").distinct()
    parts = split.select("conv", "part", "split", "start", "room").distinct()
    return parts.join(when, "conv").select("batch", F.lit(LIFE).alias("kind"), "conv", "part", "split", "start", F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "room")


def ticks(spark: SparkSession, n_buckets: int, batch: int, kind: int = TICK) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit("")
    of = {"batch": F.lit(batch), "bucket": F.col("id").cast("int"), "kind": F.lit(kind), "conv": none, "part": zero, "split": F.lit(False), "start": zero, "room": zero, "turn": zero, "role": none, "text": none}
    return spark.range(n_buckets).select(*[c.alias(n) for n, c in of.items()])


def run_batches(prepared: DataFrame, n_batches: int) -> DataFrame:
    """Events of ``prepared`` rows, fed batch by batch to the streaming query, which is started anew for each.

    Rows are written by batch first, then each batch to the folder that the query reads. Both and the
    checkpoint go at the end; the events stay."""
    spark = prepared.sparkSession
    root = fresh_path(spark, "turns")
    stored = lambda df, name: (in_few_files(df).write.partitionBy("batch").parquet(f"{root}/{name}"), spark.read.schema(schema).parquet(f"{root}/{name}"))[1]
    schema = ", ".join(c for c in FED.split(", ") if not c.startswith(("batch", "bucket"))) + ", batch int"
    rows = stored(prepared, "rows")
    if not rows.where("split").isEmpty():
        rows = rows.unionByName(stored(signs_of_life(rows), "life"))
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv", "part"), F.lit(n_buckets)).cast("int"))
    names = [c.split(" ")[0] for c in FED.split(", ")]
    for batch in range(n_batches + 1):
        tick = ticks(spark, n_buckets, batch, TICK if batch < n_batches else END).select(names).coalesce(1)
        fed = rows.where(F.col("batch") == batch).select(names).unionByName(tick) if batch < n_batches else tick
        fed.write.mode("append").parquet(f"{root}/fed")
        events = reassembled(spark.readStream.schema(FED).parquet(f"{root}/fed"))
        query = events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    delete(spark, [f"{root}/{x}" for x in ("rows", "life", "fed", "state")])
    return spark.read.schema(EVENTS).parquet(f"{root}/events")


def across_stretches(events: DataFrame) -> DataFrame:
    """Events of whole conversations from those of their stretches; unsplit ones are as they are."""
    split = events.where("split")
    closed = split.where("event = 'close'")
    by_part = W.partitionBy("conv").orderBy("part")
    before = by_part.rowsBetween(W.unboundedPreceding, -1)
    gapless = (F.row_number().over(by_part) - 1 == F.col("part")) & F.coalesce(F.min(F.col("done") >= 0).over(before), F.lit(True))
    gate = closed.withColumn("gate", F.when(gapless, F.coalesce(F.max("done").over(before), F.lit(-1))))
    joins = (F.lag("part").over(by_part) == F.col("part") - 1) & (F.lag("last_role").over(by_part) == F.col("first_role"))
    gate = gate.withColumn("joins", F.coalesce(joins, F.lit(False)).cast("long"))
    gates = gate.where("gate is not null").select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "gate")
    released = split.where("event = 'release'").join(gates, (F.col("conv") == F.col("_conv")) & (F.col("part") == F.col("_part")))
    released = released.withColumn("batch", F.greatest("batch", "gate")).select(*_NAMES)
    run = F.when(F.col("gate").isNull() & (F.col("run") > 0), F.sequence("start", F.col("start") + F.col("run") - 1)).otherwise(F.array().cast("array<long>"))
    whole = gate.withColumn("open", F.concat(run, "waiting")).groupBy("conv").agg(
        F.max("batch").alias("batch"), F.array_sort(F.collect_list(F.struct("part", "open"))).alias("open"), F.min("start").alias("start"), F.max(F.when(F.col("kept") > 0, F.col("top"))).alias("top"),
        F.sum("kept").alias("kept"), F.sum(F.col("n_breaks") + F.col("joins")).alias("n_breaks"),
    )
    of = {"event": F.lit("close"), "turn": F.lit(-1).cast("long"), "waiting": F.flatten(F.transform("open", lambda x: x["open"])), "n_missing": F.col("top") - F.col("start") + 1 - F.col("kept"), "split": F.lit(True)}
    there = {"conv", "batch", "start", "top", "kept", "n_breaks"}
    whole = whole.select(*[(of[f.name] if f.name in of else F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return reduce(DataFrame.unionByName, [events.where("not split"), split.where("event = 'reject'"), released, whole])


# -- the query ----------------------------------------------------------------------


def arrivals(conversations: DataFrame) -> DataFrame:
    """Turns dealt to batches by a checksum, some of them twice, the second time as the user's."""
    c = conversations.where("turn is not null").select(F.col("conv_id").cast("string").alias("conv"), "turn", "role", "text")
    digest = F.sha2(F.concat(F.coalesce("conv", F.lit("")), F.lit(":"), F.col("turn").cast("string")).cast("binary"), 256)
    h: Column = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    c = c.withColumn("h", h)
    once = F.struct((F.col("h") % BATCHES).cast("int").alias("batch"), F.col("role").alias("role"))
    twice = F.struct(((F.col("h") + 3) % BATCHES).cast("int").alias("batch"), F.lit("user").alias("role"))
    return c.select("conv", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, twice)).otherwise(F.array(once))).alias("a")).select("conv", "turn", "a.role", "text", "a.batch")


def op13_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases, rejects and closings of all conversations, with digests of what they hold."""
    conversations = table(spark, sf_dir, "conversations")
    events = across_stretches(run_batches(prepare(arrivals(conversations)), BATCHES))
    held = F.when(F.col("event") == "close", F.array_join("waiting", ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    ids = F.when(F.col("conv") != "", F.col("conv")).cast(conversations.schema["conv_id"].dataType)
    return events.select("event", F.sha2(held.cast("binary"), 256).alias("sha256"), ids.alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), "n_missing", "n_breaks")


SQL = {
    "op13_conversation_turns": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CAST('0x' || substr(sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || turn), 1, 8) AS BIGINT) AS h
  FROM conversations WHERE turn IS NOT NULL
), a AS (
  SELECT conv_id, turn, h % {BATCHES} AS batch, role, text FROM t
  UNION ALL SELECT conv_id, turn, (h + 3) % {BATCHES}, 'user', text FROM t WHERE h % 7 < 2
), s AS (
  SELECT conv_id, turn, batch, x.r AS role, x.p AS payload
  FROM (SELECT conv_id, turn, batch, min({{'p': role || '|' || text, 'r': role}}) AS x FROM a GROUP BY conv_id, turn, batch)
), g AS (
  SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM s)
), c AS (
  SELECT conv_id, least(coalesce(min(batch + {SILENT}) FILTER (WHERE coalesce(next, 99) > batch + {SILENT}), {BATCHES}), {BATCHES}) AS closed FROM g GROUP BY conv_id
), f AS (
  SELECT conv_id, min(turn) AS first FROM t GROUP BY conv_id
), k AS (
  SELECT s.conv_id, s.turn, min(s.batch) AS batch, arg_min(s.role, s.batch) AS role, arg_min(s.payload, s.batch) AS payload
  FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.batch < c.closed GROUP BY s.conv_id, s.turn
), o AS (
  SELECT k.*, f.first, (k.turn - f.first) = (row_number() OVER w) - 1 AS free, max(k.batch) OVER w AS released,
         coalesce((lag(k.turn) OVER w) = k.turn - 1 AND (lag(k.role) OVER w) = k.role, false) AS breaks
  FROM k JOIN f ON k.conv_id IS NOT DISTINCT FROM f.conv_id WINDOW w AS (PARTITION BY k.conv_id ORDER BY k.turn)
), z AS (
  SELECT conv_id, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE NOT free), '') AS open,
         max(turn) - min(first) + 1 - count(*) AS n_missing, count(*) FILTER (WHERE breaks) AS n_breaks
  FROM o GROUP BY conv_id
)
SELECT 'release' AS event, sha256(payload) AS sha256, conv_id, turn, CAST(released AS BIGINT) AS batch, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks FROM o WHERE free
UNION ALL
SELECT 'reject', sha256(s.payload), s.conv_id, s.turn, CAST(s.batch AS BIGINT), NULL, NULL FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.batch > c.closed
UNION ALL
SELECT 'close', sha256(z.open), z.conv_id, -1, CAST(c.closed AS BIGINT), CAST(z.n_missing AS BIGINT), CAST(z.n_breaks AS BIGINT) FROM z JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
QUERIES = {"op13_conversation_turns": op13_conversation_turns}
