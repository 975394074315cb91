"""Class scores of tokens to spans: probabilities, best path under boundary rules, entities."""
from __future__ import annotations

import numpy as np

from maskweave.constants import BOUNDARIES, NOT_ALLOWED, PII_TYPES

#: Additive scores of kinds of steps; all 0 unless calibrated.
BIASES = ("background_stay", "background_to_start", "inside_to_continue", "inside_to_end", "end_to_background", "end_to_start")


def class_names(types: tuple[str, ...] = PII_TYPES) -> list[str]:
    """O, then B, I, E and S of each type."""
    return ["O", *(f"{b}-{t}" for t in types for b in BOUNDARIES)]


def transitions(names: list[str], biases: dict[str, float] | None = None) -> np.ndarray:
    """Score of a step from class to class; NOT_ALLOWED where boundaries don't fit."""
    bias = dict.fromkeys(BIASES, 0.0) | (biases or {})
    edge = [n[0] for n in names]
    kind = [n[2:] for n in names]
    out = np.full((len(names), len(names)), NOT_ALLOWED, np.float32)
    for p in range(len(names)):
        for c in range(len(names)):
            if edge[p] in "BI":
                if edge[c] in "IE" and kind[p] == kind[c]:
                    out[p, c] = bias["inside_to_continue" if edge[c] == "I" else "inside_to_end"]
            elif edge[c] in "OBS":
                step = ("background", "stay" if edge[c] == "O" else "to_start") if edge[p] == "O" else ("end", "to_background" if edge[c] == "O" else "to_start")
                out[p, c] = bias["_".join(step)]
    return out


def best_path(logits: np.ndarray, names: list[str], step: np.ndarray) -> np.ndarray:
    """Classes of the best allowed path, in 32-bit floats; of equal ones the lowest class. It may end anywhere."""
    n = len(logits)
    if not n:
        return np.zeros(0, np.int64)
    logits = logits.astype(np.float32)
    starts = np.array([x[0] in "OBS" for x in names])
    score = np.where(starts, logits[0], np.float32(NOT_ALLOWED))
    back = np.zeros((n, len(names)), np.int64)
    closed = step <= NOT_ALLOWED / 2
    for t in range(1, n):
        reach = (score[:, None] + step) + logits[t][None, :]
        reach[closed | (score <= NOT_ALLOWED / 2)[:, None]] = NOT_ALLOWED
        back[t] = reach.argmax(axis=0)
        score = reach.max(axis=0)
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def probabilities(logits: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Softmax probability of each token's class."""
    logits = logits.astype(np.float32)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e[np.arange(len(path)), path] / e.sum(axis=1) if len(path) else np.zeros(0, np.float32)


def entities(path: list[int], names: list[str], places: list[tuple[int, int]], probs: list[float], types: set[str], text: str, first: int = 0, owned_end: int | None = None) -> list[dict]:
    """Spans of a labelled chunk. An I or E without an open entity of its type opens
    one, an E closes at once; what is open is closed by O, by a new start and by
    the end. Confidence is the mean probability; entities belong to the chunk if
    their first token lies before ``owned_end``."""
    out: list[dict] = []
    open_kind, members = "", []

    def close() -> None:
        nonlocal open_kind, members
        if members and open_kind in types and (owned_end is None or first + members[0] < owned_end):
            a, b = places[members[0]][0], places[members[-1]][1]
            if a < b <= len(text):
                out.append({"type": open_kind, "text": text[a:b], "start": a, "end": b, "confidence": float(np.mean(np.array([probs[m] for m in members], np.float32)))})
        open_kind, members = "", []

    for i, c in enumerate(path):
        edge, kind = names[c][0], names[c][2:]
        if edge == "O":
            close()
            continue
        if edge in "BS" or kind != open_kind:
            close()
            open_kind = kind
        members.append(i)
        if edge in "ES":
            close()
    close()
    return out
