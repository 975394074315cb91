"""Requests framed out of connections' chunks."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskweave.sources import traffic
from maskweave.storage import fresh_path
from maskweave.streaming import requests as R
from maskweave.streaming.parts import run_parts

T0 = datetime(2024, 1, 1)


def request(path, body, name="Content-Length"):
    data = body.encode()
    return f"POST {path} HTTP/1.1\r\nHost: h\r\n{name}: {len(data)}\r\n\r\n".encode() + data


SOME = [request("/a", "x" * 70), request("/b", ""), b"GET /c HTTP/1.1\r\nHost: h\r\n\r\n", request("/d", "\u00e9\u5b57" * 9, "CONTENT-length"), request("/e", "in\r\n\r\nside")]


@pytest.mark.parametrize("seed", range(25))
def test_chunks_of_any_size_in_any_order(seed):
    rnd = random.Random(seed)
    data, size = b"".join(SOME) + SOME[0][:-1], rnd.randint(1, 90)
    chunks = [(i, data[at : at + size]) for i, at in enumerate(range(0, len(data), size))]
    chunks += rnd.sample(chunks, len(chunks) // 3)
    rnd.shuffle(chunks)
    c, out = R.Connection(), []
    for i in range(0, len(chunks), 4):
        out += c.take(chunks[i : i + 4])
    assert out == [(i, r.decode()) for i, r in enumerate(SOME)]
    assert c.rest == SOME[0][:-1] and not c.early
    assert c.take([(c.next, b"x")]) == [(len(SOME), SOME[0].decode())] and c.rest == b""


def test_headers_that_do_not_end():
    c = R.Connection()
    assert c.take([(0, b"x" * (R.HEADER_BYTES + 1))]) == [] and c.broken and c.rest == b""
    assert c.take([(1, SOME[0])]) == []


def test_connections_over_micro_batches(spark):
    """A whole connection in two parts, and one that goes silent within a request: its state goes."""
    data = b"".join(SOME)
    chunks = [(i, data[at : at + 50]) for i, at in enumerate(range(0, len(data), 50))]
    row = lambda name, i, d, sent: (name, i, bytearray(d), sent)
    parts = [
        [row("whole", i, d, T0) for i, d in chunks if i % 2] + [row("silent", i, d, T0) for i, d in chunks[:-1]],
        [row("whole", i, d, T0) for i, d in chunks if i % 2 == 0] + [row("clock", 0, b"GET", T0 + timedelta(hours=2))],
        [row("clock", 1, b" / HTTP/1.1", T0 + timedelta(hours=2))],
    ]
    root = fresh_path(spark, "requests-test")
    frames = [spark.createDataFrame(p, "connection string, seq long, data binary, sent timestamp").repartition(2) for p in parts]
    out = run_parts(frames, lambda s: R.requests(s, "10 minutes", "1 minute"), R.OUTPUT, root)
    parsed = out.select("connection", "number", traffic.parsed_request(F.col("raw")).alias("r")).collect()
    by = lambda name: [(r.r.path, r.r.body) for r in sorted(parsed, key=lambda r: r.number) if r.connection == name]
    want = [("/a", "x" * 70), ("/b", ""), ("/c", ""), ("/d", "\u00e9\u5b57" * 9), ("/e", "in\r\n\r\nside")]
    assert by("whole") == want and by("silent") == want[:-1]
    left = spark.read.format("statestore").option("stateVarName", "known").load(f"{root}/state").selectExpr("key.connection").collect()
    assert {r.connection for r in left} == {"clock"}
