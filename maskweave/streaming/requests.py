"""A streaming source of captured requests: connections' bytes in, whole requests out.

A capture brings chunks of each connection's bytes, numbered from 0, in any
order and over any number of micro-batches. Requests are framed by the end of
their headers and their Content-Length, as many as a connection sends one after
another; ``sources.traffic.parsed_request`` takes them apart. State is kept for
each connection: bytes of the request that isn't whole yet, and chunks that came
before their turn. A connection whose headers don't end within the limit is
broken: nothing more comes of it. One that is silent for ``time_to_live``, by
event time, is forgotten with its timer, whole requests having gone out already."""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskweave.sources.traffic import BODY_BYTES, HEADER_BYTES

OUTPUT = "connection string, number long, raw string"
TIME_TO_LIVE = "10 minutes"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d*)")


@dataclass
class Connection:
    """What is known of a connection."""

    rest: bytes = b""
    next: int = 0
    number: int = 0
    broken: bool = False
    early: dict[int, bytes] = field(default_factory=dict)

    def take(self, chunks: Iterable[tuple[int, bytes]]) -> list[tuple[int, str]]:
        """(number, text) of the requests that chunks make whole, in whatever order they come."""
        for seq, data in chunks:
            if seq >= self.next:
                self.early.setdefault(seq, data)
        whole = [self.rest]
        while self.next in self.early:
            whole.append(self.early.pop(self.next))
            self.next += 1
        data, at, out = b"".join(whole), 0, []
        while not self.broken:
            end = data.find(_END, at, at + HEADER_BYTES + len(_END))
            if end < 0:
                self.broken = len(data) - at > HEADER_BYTES
                break
            found = _LENGTH.findall(data, at, end)
            begin, size = end + len(_END), min(int(found[-1] or 0) if found else 0, BODY_BYTES)
            if len(data) < begin + size:
                break
            out.append((self.number, data[at : begin + size].decode(errors="replace")))
            self.number, at = self.number + 1, begin + size
        self.rest = b"" if self.broken else data[at:]
        if self.broken:
            self.early.clear()
        return out


class Framing(StatefulProcessor):
    """Chunks (seq, data, sent) of a connection to its requests."""

    def __init__(self, time_to_live: str = TIME_TO_LIVE):
        self._ms = int(pd.Timedelta(time_to_live).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"rest": T.BinaryType(), "next": T.LongType(), "number": T.LongType(), "broken": T.BooleanType(), "ends": T.LongType(), "n_early": T.LongType()}
        self._handle = handle
        self._known = handle.getValueState("known", T.StructType([T.StructField(n, k) for n, k in kinds.items()]))
        self._early = handle.getMapState("early", T.StructType([T.StructField("seq", T.LongType())]), T.StructType([T.StructField("data", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, ends, before = Connection(), None, set()
        if self._known.exists():
            rest, following, number, broken, ends, n_early = self._known.get()
            early = {seq: bytes(data) for (seq,), (data,) in self._early.iterator()} if n_early else {}
            c, before = Connection(bytes(rest), following, number, broken, early), set(early)
        latest, chunks = ends or 0, []
        for frame in rows:
            latest = max(latest, int(frame["sent"].max().timestamp() * 1000) + self._ms)
            chunks += [(int(n), bytes(data or b"")) for n, data in zip(frame["seq"], frame["data"])]
        out = c.take(chunks)
        if latest != ends:
            if ends is not None:
                self._handle.deleteTimer(ends)
            self._handle.registerTimer(latest)
        for seq in before - c.early.keys():
            self._early.removeKey((seq,))
        for seq in c.early.keys() - before:
            self._early.updateValue((seq,), (c.early[seq],))
        self._known.update((c.rest, c.next, c.number, c.broken, latest, len(c.early)))
        yield pd.DataFrame([(key[0], n, raw) for n, raw in out], columns=["connection", "number", "raw"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._known.clear()
        self._early.clear()
        yield pd.DataFrame([], columns=["connection", "number", "raw"])

    def close(self) -> None:
        pass


def requests(chunks: DataFrame, time_to_live: str = TIME_TO_LIVE, lateness: str = "10 minutes") -> DataFrame:
    """(connection, number, raw) of a stream of (connection, seq, data, sent)."""
    rows = chunks.withWatermark("sent", lateness).groupBy("connection")
    return rows.transformWithStateInPandas(Framing(time_to_live), OUTPUT, "Append", "EventTime")
