"""The model path through a real session: a small ONNX file is written by hand, its scores depend on the whole window."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.functions import bpe as B
from maskweave.functions import decode as D
from maskweave.operators import model
from maskweave.plans.model import small_bpe

ort = pytest.importorskip("onnxruntime")
NAMES = D.class_names()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def part(field, data):
    data = data.encode() if isinstance(data, str) else data
    return varint(field << 3 | 2) + varint(len(data)) + data


def node(kind, inputs, output, **attributes):
    out = b"".join(part(1, x) for x in inputs) + part(2, output) + part(4, kind)
    for name, value in attributes.items():
        of = number(3, value) + number(20, 2) if isinstance(value, int) else b"".join(number(8, v) for v in value) + number(20, 7)
        out += part(5, part(1, name) + of)
    return part(1, out)


def tensor(name, a):
    return part(5, b"".join(number(1, n) for n in a.shape) + number(2, 1) + part(8, name) + part(9, a.astype("<f4").tobytes()))


def value(field, name, kind, *dims):
    shape = b"".join(part(1, number(1, d) if isinstance(d, int) else part(2, d)) for d in dims)
    return part(field, part(1, name) + part(2, part(1, number(1, kind) + part(2, shape))))


@pytest.fixture(scope="module")
def weights():
    bpe = small_bpe()
    w = np.random.default_rng(3).normal(0, 0.4, (max(bpe.vocab.values()) + 1, len(NAMES))).astype(np.float32)
    w[:, 0] += 2
    w[bpe.vocab["\u0120the"], NAMES.index("S-secret")] += 9
    w[bpe.vocab["ing"], NAMES.index("S-private_person")] += 9
    return w


@pytest.fixture(scope="module")
def path(weights, tmp_path_factory):
    """logits = rows of the weights + a hundredth of the sum of the window's rows, padding left out."""
    graph = (
        node("Gather", ["w", "input_ids"], "g", axis=0) + node("Cast", ["attention_mask"], "m", to=1) + node("Unsqueeze", ["m"], "u", axes=[2])
        + node("Mul", ["g", "u"], "k") + node("ReduceSum", ["k"], "s", axes=[1], keepdims=1) + node("Mul", ["s", "c"], "t") + node("Add", ["g", "t"], "logits")
        + part(2, "small") + tensor("w", weights) + tensor("c", np.array([0.01]))
        + value(11, "input_ids", 7, "b", "n") + value(11, "attention_mask", 7, "b", "n") + value(12, "logits", 1, "b", "n", len(NAMES))
    )
    at = tmp_path_factory.mktemp("model") / "small.onnx"
    at.write_bytes(number(1, 7) + part(8, number(2, 12)) + part(7, graph))
    return str(at)


def plain(text, weights, size, overlap):
    """A loop over windows, without any batch."""
    bpe, step, out = small_bpe(), D.transitions(NAMES), []
    pieces = bpe.encode(text)
    places = B.char_places(text, pieces)
    for a, b, owned in model.windows(len(pieces), size, overlap):
        rows = weights[[p.id for p in pieces[a:b]]]
        logits = rows + np.float32(0.01) * rows.sum(0)
        best = D.best_path(logits, NAMES, step)
        out += D.entities(best.tolist(), NAMES, places[a:b], D.probabilities(logits, best).tolist(), set(model.PII_TYPES), text, a, owned)
    return out


def texts():
    rnd = random.Random(8)
    some = ["", None, "the", "of the", "a the b"] + [" ".join(rnd.choice(["the", "sing", "other", "\u00e9", "in"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return [*some, some[9], some[9], "the " * 700]


def same(got, want):
    assert [(s["type"], s["text"], s["start"], s["end"]) for s in got] == [(s["type"], s["text"], s["start"], s["end"]) for s in want]
    assert np.allclose([s["confidence"] for s in got], [s["confidence"] for s in want], atol=1e-4)


@pytest.mark.parametrize("tokens", [1, 100, model.BATCH_TOKENS])
def test_batches_of_windows_equal_a_loop(path, weights, tokens):
    some = [t or "" for t in texts()]
    scores = model.onnx_scores(path)()
    for got, t in zip(model.spans_of_texts(some, small_bpe(), scores, set(model.PII_TYPES), None, 40, 8, tokens), some):
        same(got, plain(t, weights, 40, 8))


def test_spans_over_a_table(spark, path, weights):
    df = spark.createDataFrame(list(enumerate(texts())), "id long, text string").repartition(3)
    rows = model.detect(df, small_bpe, model.onnx_scores(f"file://{path}"), size=40, overlap=8).collect()
    found = 0
    for r in rows:
        want = plain(r.text or "", weights, 40, 8)
        same([s.asDict() for s in r.spans], want)
        found += len(want)
    assert len(rows) == len(texts()) and found > 200
    assert df.limit(0).transform(lambda d: model.detect(d, small_bpe, model.onnx_scores(path))).select(F.size("spans")).collect() == []


def test_windows_of_like_length_go_together():
    assert model.batches([5, 1, 5, 2, 9], 10) == [[1, 3], [0, 2], [4]] and model.batches([], 10) == [] and model.batches([99], 10) == [[0]]
    lengths = [random.Random(1).randint(1, 50) for _ in range(200)]
    groups = model.batches(lengths, 128)
    assert sorted(i for g in groups for i in g) == list(range(200)) and all(max(lengths[i] for i in g) * len(g) <= 128 for g in groups)


def test_a_worker_has_one_session(path):
    model._SESSIONS.clear()
    model.onnx_scores(path)(), model.onnx_scores(path)()
    assert len(model._SESSIONS) == 1


def test_providers():
    cpu = "CPUExecutionProvider"
    assert model.providers("cpu", ["CUDAExecutionProvider", cpu]) == [cpu]
    assert model.providers("auto", ["CUDAExecutionProvider", cpu]) == ["CUDAExecutionProvider", cpu] and model.providers("gpu", [cpu]) == [cpu]
