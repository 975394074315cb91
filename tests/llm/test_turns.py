"""Conversations put together again, against a plain loop over arrivals."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.llm import turns


def plain(arrivals, n_batches):
    """Events as (event, conv, turn, batch, what, n_missing, n_breaks) from (conv, turn, role, text, batch)."""
    rows = [(c or "", t, r or "", x or "", b) for c, t, r, x, b in arrivals if t is not None]
    first, out = {}, []
    for c, t, *_ in rows:
        first[c] = min(t, first.get(c, t))
    for conv in first:
        kept, run, seen, silent, closed = {}, first[conv], False, 0, None

        def close(batch):
            order = sorted(kept)
            breaks = sum(t - 1 in kept and kept[t - 1][0] == kept[t][0] for t in order)
            out.append(("close", conv, -1, batch, ",".join(str(t) for t in order if t >= run), order[-1] - first[conv] + 1 - len(order), breaks))

        for b in range(n_batches):
            here = {}
            for c, t, r, x, at in rows:
                if c == conv and at == b:
                    here.setdefault(t, []).append((f"{r}|{x}".encode(), r))
            if closed is not None:
                out += [("reject", conv, t, b, min(v)[0].decode(), None, None) for t, v in here.items()]
                continue
            for t, v in here.items():
                kept.setdefault(t, (min(v)[1], min(v)[0].decode()))
            seen, silent = seen or bool(here), 0 if here else silent + seen
            while run in kept:
                out.append(("release", conv, run, b, kept[run][1], None, None))
                run += 1
            if silent == 3:
                close(b)
                closed = b
        if closed is None:
            close(n_batches)
    return sorted(out, key=repr)


def told(events):
    what = F.when(F.col("event") == "close", F.array_join("waiting", ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    rows = events.select("event", "conv", "turn", "batch", what, "n_missing", "n_breaks").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def drawn(seed, n_convs, most=12):
    rnd, out = random.Random(seed), []
    for k in range(n_convs):
        conv, base = f"c{k}" if k else None, rnd.choice([0, 0, -3, 5, 1 << 40])
        batches = rnd.sample(range(8), rnd.randint(1, 8))
        for t in range(rnd.randint(1, most)):
            if rnd.random() < 0.15:
                continue
            for _ in range(rnd.choice([1, 1, 1, 2, 3])):
                out.append((conv, base + t, rnd.choice(["user", "assistant", None, ""]), rnd.choice(["x", "y é", None, "a|b", ""]), rnd.choice(batches)))
    out += [("dup", 1, "user", "same", 2)] * 5 + [("dup", 1, "a|b", "c", 2), ("dup", 1, "a", "b|c", 2), ("null", None, "user", "x", 1), ("dup", 2, "user", "z", 7)]
    return out


@pytest.mark.parametrize("shift", [turns.SHIFT, 2])
def test_events(spark, shift):
    rows = drawn(shift, 40, 40 if shift == 2 else 12)
    df = spark.createDataFrame(rows, "conv string, turn long, role string, text string, batch int").repartition(3)
    got = told(turns.across_stretches(turns.run_batches(turns.prepare(df, shift), 8)))
    want = plain(rows, 8)
    assert got == want
    assert {e for e, *_ in want} == {"release", "reject", "close"} and any("," in e[4] for e in want)


def fed(rows, batch, end=False):
    """Rows of a bucket as columns; conversations are not split."""
    first = {}
    for c, t, *_ in rows:
        first[c] = min(t, first.get(c, t))
    here = [r for r in rows if r[4] == batch]
    kinds = [turns.TURN] * len(here) + [turns.END if end else turns.TICK]
    of = lambda x: np.array([*x, None], object)
    zero = np.zeros(len(kinds), np.int64)
    return {"kind": np.array(kinds), "conv": of(r[0] for r in here), "part": zero, "split": zero > 0, "start": np.array([*(first[r[0]] for r in here), 0]), "room": zero + 1000,
            "turn": np.array([*(r[1] for r in here), 0]), "role": of(r[2] for r in here), "text": of(r[3] for r in here)}


@pytest.mark.parametrize("seed", range(30))
def test_a_bucket_batch_by_batch(seed):
    rows = [(c or "", t, r or "", x or "", b) for c, t, r, x, b in drawn(seed, 12) if t is not None]
    convs, waiting, got = turns.unpack(None, turns._CONVS), turns.unpack(None, turns._WAITING), []
    for b in range(9):
        convs, waiting, events = turns.merge(convs, waiting, fed(rows, b, b == 8), b)
        convs, waiting = turns.unpack(turns.pack(convs, turns._CONVS), turns._CONVS), turns.unpack(turns.pack(waiting, turns._WAITING), turns._WAITING)
        for e in events:
            for r in e.itertuples():
                what = ",".join(map(str, r.waiting)) if r.event == "close" else f"{r.role}|{r.text}"
                got.append((r.event, r.conv, r.turn, r.batch, what, r.n_missing if r.event == "close" else None, r.n_breaks if r.event == "close" else None))
    assert sorted(got, key=repr) == plain(rows, 8)
    assert len(waiting["at"]) == 0 and convs["closed"].all()


def test_a_repeated_turn_meets_before_it_is_dealt(spark):
    df = spark.createDataFrame([("c", 1, "user", f"t{i % 3}", 0) for i in range(3000)], "conv string, turn long, role string, text string, batch int").repartition(8)
    got = turns.prepare(df).collect()
    assert [(r.turn, r.text, r.split, r.part) for r in got] == [(1, "t0", False, 0)]


def test_query_and_nothing(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(9)] + [(2, None, "user", "x"), (3, 4, None, None), (None, 0, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS batch", "2 AS bucket", "3 AS kind").write.parquet(f"{tmp_path}/conversations.parquet")
    dealt = []
    for c, t, r, x in rows:
        if t is not None:
            h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
            dealt.append((None if c is None else str(c), t, r, x, h % 8))
            dealt += [(None if c is None else str(c), t, "user", x, (h + 3) % 8)] if h % 7 < 2 else []
    want = sorted(((e, hashlib.sha256(w.encode()).hexdigest(), int(c) if c else None, t, b, m, n) for e, c, t, b, w, m, n in plain(dealt, 8)), key=repr)
    got = turns.op13_conversation_turns(spark, str(tmp_path))
    assert got.columns == ["event", "sha256", "conv_id", "turn", "batch", "n_missing", "n_breaks"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert turns.op13_conversation_turns(spark, f"{tmp_path}/none").collect() == []
