"""Detection with a token-classification model: tokens, windows, scores, spans.

Everything around the scores is here; the scores come from a function of windows
of token ids, made once for each Python worker. ``onnx_scores`` makes one from an
ONNX file: windows of the texts of an Arrow batch are put together by length and
go through the worker's one session up to ``BATCH_TOKENS`` at a time, padding
masked. A window's scores are used for what it owns only, so neither windows nor
batches show in the spans."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import CHUNK_OVERLAP, CHUNK_TOKENS, PII_TYPES
from maskweave.functions import bpe as B
from maskweave.functions import decode as D
from maskweave.functions.spans import SPANS

Score = Callable[[list[int]], np.ndarray]
Scores = Callable[[list[list[int]]], list[np.ndarray]]
#: Tokens that go through the model together, padding included; texts whose pieces are held at a time.
BATCH_TOKENS, TEXTS = 1 << 17, 256
#: Names that the runtime gives to graphics processors, the preferred one first.
GPU_PROVIDERS = ("DmlExecutionProvider", "CUDAExecutionProvider")


def windows(n: int, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, owned end) of the windows over n tokens."""
    out, start = [], 0
    while start < n:
        end = min(n, start + size)
        out.append((start, end, n if end == n else start + size - overlap))
        if end == n:
            break
        start += size - overlap
    return out


def one_by_one(score: Score) -> Scores:
    """Scores of windows by a function of one window."""
    return lambda windows: [score(ids) for ids in windows]


def batches(lengths: list[int], tokens: int = BATCH_TOKENS) -> list[list[int]]:
    """Numbers of windows to score together: by length, as many as fill ``tokens`` with padding, at least one."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * lengths[i] <= tokens:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def spans_of_texts(texts: list[str], bpe: B.Bpe, scores: Scores, types: set[str], biases: dict[str, float] | None = None, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, tokens: int = BATCH_TOKENS) -> list[list[dict]]:
    """Spans of texts. Scores are held for one batch of windows at a time."""
    names = D.class_names()
    step = D.transitions(names, biases)
    pieces = [bpe.encode(t) for t in texts]
    places = [B.char_places(t, p) for t, p in zip(texts, pieces)]
    cut = [(i, *w) for i, p in enumerate(pieces) for w in windows(len(p), size, overlap)]
    found: list[list[dict]] = [[] for _ in cut]
    for group in batches([b - a for _, a, b, _ in cut], tokens):
        ids = [[p.id for p in pieces[i][a:b]] for i, a, b, _ in map(cut.__getitem__, group)]
        for w, logits in zip(group, scores(ids)):
            i, a, b, owned = cut[w]
            path = D.best_path(logits, names, step)
            found[w] = D.entities(path.tolist(), names, places[i][a:b], D.probabilities(logits, path).tolist(), types, texts[i], a, owned)
    out: list[list[dict]] = [[] for _ in texts]
    for (i, *_), spans in zip(cut, found):
        out[i] += spans
    return out


def spans_of(text: str, bpe: B.Bpe, score: Score, types: set[str], biases: dict[str, float] | None = None, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> list[dict]:
    """Spans of a text, window after window; a window keeps its own scores whatever the others do."""
    return spans_of_texts([text], bpe, one_by_one(score), types, biases, size, overlap)[0]


def detect(docs: DataFrame, make_bpe: Callable[[], B.Bpe], make_scores: Callable[[], Scores], text: str = "text", types: tuple[str, ...] = PII_TYPES, name: str = "spans", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``docs`` with raw spans by the model; merge them and apply the threshold with ``functions.spans``."""

    @F.pandas_udf(SPANS)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe, scores = make_bpe(), make_scores()
        for s in series:
            texts, out = [t or "" for t in s], []
            for i in range(0, len(texts), TEXTS):
                out += spans_of_texts(texts[i : i + TEXTS], bpe, scores, set(types), None, size, overlap)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(name, run(text))


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts meanwhile can be ended by ``cancel``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the jobs under a tag."""
    spark.sparkContext.cancelJobsWithTag(tag)


#: Sessions of this worker by file, provider and threads.
_SESSIONS: dict[tuple, object] = {}


def providers(choice: str, available: list[str]) -> list[str]:
    """Execution providers for ``auto``, ``gpu`` or ``cpu``, the best that there is first; the CPU is always the last."""
    gpu = [p for p in GPU_PROVIDERS if p in available] if choice in ("auto", "gpu") else []
    return [*gpu[:1], "CPUExecutionProvider"]


def _session(path: str, threads: int, provider: str):
    import onnxruntime as ort

    key = path, threads, provider
    if key not in _SESSIONS:
        options = ort.SessionOptions()
        options.intra_op_num_threads = threads
        model: str | bytes = path
        if "://" in path:
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_stream(name) as f:
                model = f.read()
        _SESSIONS[key] = ort.InferenceSession(model, options, providers=providers(provider, ort.get_available_providers()))
    return _SESSIONS[key]


def onnx_scores(path: str, threads: int = 4, provider: str = "cpu") -> Callable[[], Scores]:
    """A factory of scores by an ONNX model with ``input_ids`` and ``attention_mask``. ``path``: a file that all workers reach, or its URI."""

    def make() -> Scores:
        run = _session(path, threads, provider).run

        def scores(windows: list[list[int]]) -> list[np.ndarray]:
            ids = np.zeros((len(windows), max(map(len, windows))), np.int64)
            mask = np.zeros_like(ids)
            for row, window in enumerate(windows):
                ids[row, : len(window)], mask[row, : len(window)] = window, 1
            logits = run(None, {"input_ids": ids, "attention_mask": mask})[0]
            return [logits[row, : len(window)] for row, window in enumerate(windows)]

        return scores

    return make


def tokenizer_from(path: str) -> Callable[[], B.Bpe]:
    """A factory of encoders from a tokenizer file with ``model.vocab`` and ``model.merges``."""

    def make() -> B.Bpe:
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return B.Bpe(model["vocab"], [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    return make


def labels_from(config: dict) -> list[str]:
    """Class names in order from a model's ``id2label``."""
    return [config["id2label"][str(i)] for i in range(len(config["id2label"]))]


def biases_from(calibration: dict) -> dict[str, float]:
    """Biases from a calibration file's ``transition_bias_*`` numbers, wherever they are nested."""
    out: dict[str, float] = {}

    def walk(node) -> None:
        for k, v in node.items() if isinstance(node, dict) else ():
            if isinstance(v, (int, float)) and k.startswith("transition_bias_"):
                out[k.removeprefix("transition_bias_")] = float(v)
            walk(v)

    walk(calibration)
    return out
