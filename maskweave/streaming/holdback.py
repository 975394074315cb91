"""Restoring streams as they come: events are held back while a label may be open.

Chunks of a stream carry a number (from 0), the time they were sent, and the last
one an end mark; labels come with each chunk, as the request that was redacted
knows them. State is kept for each stream: the unfinished end of what was
received, the payloads held back, and chunks that came before their turn.

*Order.* Chunks are taken by number, whichever micro-batch brings them: one that
comes early waits in a list, and one that came before is left out. A call of the
state costs more than a chunk, so what a micro-batch brings a stream is one call. So shuffled and repeated chunks give the same texts.

*Lifetime.* A stream ends with its last chunk; its state is dropped then. One
that is abandoned ends ``time_to_live`` after its latest chunk, by event time: a
timer flushes it. What waits goes out as it would at an end mark, chunks that
came early included, in order of their numbers, as if those missing were empty.
So state is bounded by the streams of the last ``time_to_live``. Chunks that
come later than the watermark are dropped by Spark; a chunk of an ended stream
that isn't late begins a stream anew."""
from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskweave.functions import events as E
from maskweave.storage import fresh_path
from maskweave.streaming.parts import run_parts

OUTPUT = "stream_id string, out_seq long, body string"
TIME_TO_LIVE = "30 minutes"
Chunk = tuple[str, bool, dict[str, str]]  # text, last one, labels


@dataclass
class Open:
    """What is known of an open stream."""

    rest: str = ""
    out_seq: int = 0
    next: int = 0
    labels: dict[str, str] = field(default_factory=dict)
    held: list[str] = field(default_factory=list)
    early: dict[int, Chunk] = field(default_factory=dict)
    ended: bool = False

    def take(self, chunks: Iterable[tuple[int, Chunk]]) -> list[tuple[int, str]]:
        """(out_seq, body) of what chunks set free, in whatever order they come."""
        for seq, chunk in chunks:
            if seq >= self.next:
                self.early.setdefault(seq, chunk)
        out = []
        while not self.ended and self.next in self.early:
            out += self._add(*self.early.pop(self.next))
            self.next += 1
        return out

    def flush(self) -> list[tuple[int, str]]:
        """All that is left, though chunks may be missing."""
        out = []
        for seq in sorted(self.early):
            if not self.ended:
                out += self._add(*self.early[seq])
        return out if self.ended else out + self._add("", True, self.labels)

    def _add(self, text: str, last: bool, labels: dict[str, str]) -> list[tuple[int, str]]:
        payloads, self.rest = E.frame(self.rest + text)
        self.labels = labels or self.labels
        self.held += payloads
        if last:
            self.held, self.rest, self.ended = [*self.held, *E.flushed(self.rest)], "", True
        if not self.held or not last and any(E.open_label(t, list(self.labels)) for t in E.pending_text(self.held)):
            return []
        body = E.serialise(E.rebuild(self.held, E.restorer(self.labels)))
        self.held, self.out_seq = [], self.out_seq + 1
        return [(self.out_seq - 1, body)]


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


class HoldBack(StatefulProcessor):
    """Chunks (seq, chunk, last, labels, sent) of a stream to restored events."""

    def __init__(self, time_to_live: str = TIME_TO_LIVE):
        self._ms = int(pd.Timedelta(time_to_live).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", _fields(rest=T.StringType(), out_seq=T.LongType(), next=T.LongType(), labels=T.StringType(), ends=T.LongType(), n_held=T.LongType(), n_early=T.LongType()))
        self._held = handle.getListState("held", _fields(payload=T.StringType()))
        self._early = handle.getListState("early", _fields(seq=T.LongType(), chunk=T.StringType(), last=T.BooleanType(), labels=T.StringType()))

    def _load(self) -> tuple[Open, int | None, int, set[int]]:
        """The stream, when its timer ends it, and the number of held payloads and the early chunks that the state has."""
        found = self._open.get()
        if found is None:
            return Open(), None, 0, set()
        rest, out_seq, following, labels, ends, n_held, n_early = found
        held = [p for (p,) in self._held.get()] if n_held else []
        early = {seq: (chunk, last, json.loads(some)) for seq, chunk, last, some in self._early.get()} if n_early else {}
        return Open(rest, out_seq, following, json.loads(labels), held, early), ends, n_held, set(early)

    def _store(self, o: Open, ends: int, n_held: int, before: set[int]) -> None:
        self._open.update((o.rest, o.out_seq, o.next, json.dumps(o.labels), ends, len(o.held), len(o.early)))
        if o.held:
            self._held.put([(p,) for p in o.held])
        elif n_held:
            self._held.clear()
        gone, new = before - o.early.keys(), o.early.keys() - before
        rows = [(seq, chunk, last, json.dumps(labels)) for seq, (chunk, last, labels) in o.early.items() if gone or seq in new]
        if gone and not rows:
            self._early.clear()
        elif rows:
            (self._early.put if gone else self._early.appendList)(rows)

    def _drop(self, n_held: int, before: set[int]) -> None:
        self._open.clear()
        if n_held:
            self._held.clear()
        if before:
            self._early.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        o, ends, n_held, before = self._load()
        latest, out = ends or 0, []
        for frame in rows:
            latest = max(latest, int(frame["sent"].max().timestamp() * 1000) + self._ms)
            out += o.take((int(n), (text or "", bool(last), dict(labels or {}))) for n, text, last, labels in zip(frame["seq"], frame["chunk"], frame["last"], frame["labels"]))
        if ends is not None and (o.ended or latest != ends):
            self._handle.deleteTimer(ends)
        if o.ended:
            if ends is not None:
                self._drop(n_held, before)
        else:
            if latest != ends:
                self._handle.registerTimer(latest)
            self._store(o, latest, n_held, before)
        if out:  # an empty frame costs as much as a full one
            yield _bodies(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        o, _, n_held, before = self._load()
        self._drop(n_held, before)
        yield _bodies(key, o.flush())

    def close(self) -> None:
        pass


def _bodies(key, out: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], n, body) for n, body in out], columns=["stream_id", "out_seq", "body"])


def restored(chunks: DataFrame, time_to_live: str = TIME_TO_LIVE, lateness: str = "10 minutes") -> DataFrame:
    """Restored bodies of a stream of (stream_id, seq, chunk, last, labels, sent)."""
    rows = chunks.withWatermark("sent", lateness).groupBy("stream_id")
    return rows.transformWithStateInPandas(HoldBack(time_to_live), OUTPUT, "Append", "EventTime")


def run_once(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Turns as redacted chat streams, whose odd chunks come before the even ones; their contents put together."""
    first = F.split_part("text", F.lit(" "), F.lit(1))
    label = "<<REDACTED_KEYWORD_0>>"
    marked = turns.select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), F.when(F.length(first) > 2, F.replace("text", first, F.lit(label))).otherwise(F.col("text")).alias("text"), first.alias("first"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 9)).cast("int")
    pieces = marked.select("stream_id", "first", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", i * 9 + 1, F.lit(9)))).alias("seq", "piece"))
    body = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    chunks = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), body.alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last"), F.create_map(F.lit(label), F.col("first")).alias("labels"), F.lit("2024-01-01").cast("timestamp").alias("sent"))
    bodies = run_parts([chunks.where("seq % 2 = 1"), chunks.where("seq % 2 = 0")], restored, OUTPUT, fresh_path(spark, "stream"))
    from maskweave.operators.sse import chat_content, event_payloads

    out = bodies.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("out_seq", "body"))).alias("bs"))
    text = F.array_join(F.transform(event_payloads(F.array_join(F.transform("bs", lambda b: b["body"]), "")), lambda p: chat_content(p)), "")
    return out.select(F.split_part("stream_id", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("stream_id", F.lit("/"), F.lit(2)).cast("long").alias("turn"), text.alias("content"))
