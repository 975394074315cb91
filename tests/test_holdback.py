"""The hold-back operator: order over micro-batches, repeated chunks, abandoned streams."""
import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from maskweave.functions import events as E
from maskweave.storage import fresh_path
from maskweave.streaming import holdback
from maskweave.streaming.parts import run_parts

CHUNKS = "stream_id string, seq long, chunk string, last boolean, labels map<string,string>, sent timestamp"
LABELS = {"<<REDACTED_PII_0>>": "a@b.de", "<<REDACTED_PII_1>>": "Ada"}
T0 = datetime(2024, 1, 1)


def stream(text, size):
    """A body of chat events whose contents are pieces of a text."""
    return "".join("data: " + json.dumps({"choices": [{"delta": {"content": text[i : i + size]}}]}) + "\n\n" for i in range(0, len(text), size))


def contents(bodies):
    payloads, rest = E.frame("".join(bodies))
    assert not rest
    return "".join(E.parse(p)["choices"][0]["delta"]["content"] for p in payloads)


def cut(body, size):
    return [body[i : i + size] for i in range(0, len(body), size)]


def restored(text):
    return E.restorer(LABELS)(text)


@pytest.mark.parametrize("seed", range(20))
def test_chunks_in_any_order_give_the_same_texts(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["word ", "<<REDACTED_PII_0>>", "<<REDACTED_PII_1>>", "<<", "é>>"]) for _ in range(20))
    pieces = cut(stream(text, rnd.randint(1, 9)), rnd.randint(5, 60))
    chunks = [(i, (p, i == len(pieces) - 1, LABELS)) for i, p in enumerate(pieces)]
    in_order, shuffled = holdback.Open(), holdback.Open()
    want = [b for c in chunks for _, b in in_order.take([c])]
    mixed = chunks + rnd.sample(chunks, len(chunks) // 2)
    rnd.shuffle(mixed)
    out = []
    while mixed:
        n = rnd.randint(1, 5)
        out += shuffled.take(mixed[:n])
        mixed = mixed[n:]
    assert [n for n, _ in out] == list(range(len(out))) and in_order.ended and shuffled.ended and not shuffled.early
    assert [b for _, b in out] == want
    assert contents(b for _, b in out) == restored(text)


def test_what_is_left_of_an_abandoned_stream():
    pieces = cut(stream("x <<REDACTED_PII_0>> y <<REDACTED_PI", 4), 30)
    o = holdback.Open()
    out = o.take((i, (p, False, LABELS)) for i, p in enumerate(pieces) if i not in (3,))
    assert o.early and not o.ended
    out += o.flush()
    assert o.ended and o.rest == "" and not o.held
    whole = holdback.Open()
    got = whole.take((i, (p, False, LABELS)) for i, p in enumerate(pieces)) + whole.flush()
    assert contents(b for _, b in got) == "x a@b.de y <<REDACTED_PI"
    assert holdback.Open().flush() == []


def rows(name, pieces, sent, skip=(), ends=True):
    return [(name, i, p, ends and i == len(pieces) - 1, LABELS, sent) for i, p in enumerate(pieces) if i not in skip]


def test_streams_over_micro_batches(spark):
    """A stream that is cut off is flushed by its timer and leaves no state; others go on."""
    text = "mail <<REDACTED_PII_0>> and <<REDACTED_PII_1>> end"
    pieces = cut(stream(text, 5), 40)
    rnd = random.Random(1)
    shuffled = rows("shuffled", pieces, T0)
    rnd.shuffle(shuffled)
    half = len(shuffled) // 2
    later, much_later = T0 + timedelta(minutes=20), T0 + timedelta(hours=3)
    batches = [
        rows("abandoned", pieces, T0, skip=(len(pieces) - 1,), ends=False) + shuffled[:half] + rows("whole", pieces, T0),
        shuffled[half:] + shuffled[:3] + rows("slow", pieces, later, skip=range(2, 99), ends=False),
        rows("clock", pieces, much_later, skip=range(1, 99), ends=False),
    ]
    root = fresh_path(spark, "holdback-test")
    out = run_parts([spark.createDataFrame(b, CHUNKS).repartition(2) for b in batches], lambda s: holdback.restored(s, "30 minutes", "1 minute"), holdback.OUTPUT, root).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.out_seq):
        by.setdefault(r.stream_id, []).append(r.body)
    assert contents(by["whole"]) == contents(by["shuffled"]) == restored(text)
    payloads = E.frame("".join(by["abandoned"]))[0]
    said = "".join(E.parse(p)["choices"][0]["delta"]["content"] for p in payloads if E.parse(p))
    assert said in {restored(text[:k]) for k in range(len(text) // 2, len(text))}
    assert "slow" in by and "clock" not in by
    left = spark.read.format("statestore").option("stateVarName", "open").load(f"{root}/state").selectExpr("key.stream_id").collect()
    assert {r.stream_id for r in left} == {"clock"}


class Counted:
    """A state of one stream that counts its calls."""

    def __init__(self):
        self.rows, self.calls = None, 0

    def _call(self, rows):
        self.calls += 1
        self.rows = rows

    def get(self):
        self.calls += 1
        return self.rows

    def update(self, row):
        self._call(row)

    def put(self, rows):
        self._call(list(rows))

    def appendList(self, rows):
        self._call([*(self.rows or []), *rows])

    def clear(self):
        self._call(None)


class Handle(dict):
    timers = 0

    def getValueState(self, name, _):
        return self.setdefault(name, Counted())

    getListState = getValueState

    def registerTimer(self, _):
        self.timers += 1

    def deleteTimer(self, _):
        self.timers -= 1


def test_calls_of_the_state_do_not_grow_with_the_chunks():
    from maskweave.streaming.holdback import HoldBack

    def run(n):
        handle, out = Handle(), []
        held = HoldBack()
        held.init(handle)
        at = pd.Timestamp("2024-01-01")
        chunk = lambda i: f'data: {{"choices":[{{"delta":{{"content":"c{i} "}}}}]}}\n\n'
        for part in (range(1, n, 2), range(2, n, 4), range(0, n, 4)):
            frame = pd.DataFrame([(i, chunk(i), i == n - 1, {"<<REDACTED_PII_0>>": "x"}, at) for i in part], columns=["seq", "chunk", "last", "labels", "sent"])
            out += [b for f in held.handleInputRows(("s",), iter([frame]), None) for b in f["body"]]
        assert all(s.rows is None for s in handle.values()) and handle.timers == 0
        assert [p.split('"content":"')[1].split('"')[0] for p in "".join(out).split("\n\n") if p] == [f"c{i} " for i in range(n)]
        return sum(s.calls for s in handle.values())

    assert run(8) == run(200) <= 14
