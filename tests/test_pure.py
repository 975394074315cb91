"""Cores that need no Spark, against hand-computed results and plain loops."""
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskweave.functions import bpe as B
from maskweave.functions import decode as D
from maskweave.functions import events as E
from maskweave.operators.model import spans_of, windows
from maskweave.plans.model import small_bpe
from maskweave.sources import settings as cfg


@pytest.mark.parametrize("text, lengths, expected", [
    ("The plan is Project Chimera.", [12, 11, 11, 1], ["The plan ", "is Proje", "ct Chime", "ra."]),
    ("Bob", [18, 0, 1], ["Bo", "b", ""]),
    ("any", [0, 0, 0], ["", "", ""]),
    ("ab", [1, 1, 1], ["a", "b", ""]),
])
def test_redistribute(text, lengths, expected):
    assert E.redistribute(text, lengths) == expected


@given(st.text(max_size=40), st.lists(st.integers(0, 9), min_size=1, max_size=8))
def test_redistribute_keeps_text(text, lengths):
    out = E.redistribute(text, lengths)
    assert len(out) == len(lengths) and ("".join(out) == text or not sum(lengths))


@pytest.mark.parametrize("text, held", [("abc", False), ("x <", True), ("x <<RED", True), ("x <<REDACTED_KEYWORD_0>", True), ("x <<REDACTED_KEYWORD_0>>", False), ("x << y", False), ("", False)])
def test_open_label(text, held):
    assert E.open_label(text, ["<<REDACTED_KEYWORD_0>>"]) is held


def test_frame_joins_data_lines_and_keeps_the_rest():
    events, rest = E.frame("event: x\r\ndata: a\r\ndata:b\r\n\r\n: note\n\ndata:  \n\ndata: c")
    assert events == ["ab"] and rest == "data: c"
    assert E.flushed(rest) == ["c"] and E.flushed(" \n") == [] and E.flushed("tail") == ["tail"]


def _chat(piece, name="content"):
    return json.dumps({"choices": [{"delta": {name: piece}}]})


def test_rebuild_chat_reasoning_tools_and_done():
    label = "<<REDACTED_PII_0>>"
    tool = lambda p: json.dumps({"choices": [{"delta": {"tool_calls": [{"index": 3, "function": {"arguments": p}}]}}]})
    payloads = [_chat(label[:9]), _chat(label[5:], "reasoning"), tool(label[:4]), _chat(label[9:]), tool(label[4:]), E.DONE]
    out = E.rebuild(payloads, E.restorer({label: "Bob Marley"}))
    fields = E.channels([E.parse(p) for p in out])
    joined = {k: "".join(t for _, _, t in f) for k, f in fields.items()}
    assert joined[("chat", 0, "content", 0)] == joined[("chat", 0, "tool", 3)] == "Bob Marley"
    assert joined[("chat", 0, "reasoning", 0)] == label[5:] and out[-1] == E.DONE


def test_rebuild_blocks_and_responses():
    label = "<<REDACTED_KEYWORD_0>>"
    restore = E.restorer({label: "Chimera"})
    blocks = [json.dumps({"type": "content_block_start", "content_block": {"type": "text", "text": label[:3]}}), json.dumps({"type": "content_block_delta", "delta": {"type": "text_delta", "text": label[3:]}})]
    assert "".join(t for f in E.channels([E.parse(p) for p in E.rebuild(blocks, restore)]).values() for _, _, t in f) == "Chimera"
    delta = lambda p: json.dumps({"type": "response.output_text.delta", "item_id": "i", "output_index": 0, "delta": p})
    done = json.dumps({"type": "response.completed", "response": {"output": [{"content": [{"text": label}]}], "output_text": label}})
    out = [json.loads(p) for p in E.rebuild([delta(label[:8]), delta(label[8:]), done], restore)]
    assert out[0]["delta"] + out[1]["delta"] == "Chimera"
    assert out[2]["response"]["output"][0]["content"][0]["text"] == out[2]["response"]["output_text"] == "Chimera"


def test_event_lines():
    assert E.with_event_lines(['{"type":"ping"}', "raw", E.DONE]) == 'event: ping\ndata: {"type":"ping"}\n\ndata: raw\n\n'


@pytest.mark.parametrize("logits, path", [([[0, 2, 0, 0, 1], [0, 0, 1, 0, 3], [5, 0, 0, 2, 0]], "SSO"), ([[1, 0, 9, 0, 0], [0, 0, 0, 4, 0]], "BE"), ([[0, 3, 0, 0, 0]], "B")])
def test_best_path_goldens(logits, path):
    names = ["O", "B-x", "I-x", "E-x", "S-x"]
    got = D.best_path(np.array(logits, np.float32), names, D.transitions(names))
    assert "".join(names[c][0] for c in got) == path


@settings(max_examples=60)
@given(st.integers(1, 4), st.integers(0, 10**6))
def test_best_path_is_the_best(n, seed):
    names = D.class_names(("a", "b"))
    step = D.transitions(names, {"background_stay": 0.5, "end_to_start": -1.0})
    logits = np.random.default_rng(seed).integers(-4, 5, (n, len(names))).astype(np.float32)

    def score(path):
        if names[path[0]][0] not in "OBS":
            return None
        total = logits[0, path[0]]
        for t in range(1, n):
            if step[path[t - 1], path[t]] <= D.NOT_ALLOWED / 2:
                return None
            total = total + step[path[t - 1], path[t]] + logits[t, path[t]]
        return float(total)

    paths = [()]
    for _ in range(n):
        paths = [(*p, c) for p in paths for c in range(len(names)) if not p or step[p[-1], c] > D.NOT_ALLOWED / 2]
    best = max(s for p in paths if (s := score(p)) is not None)
    assert score(tuple(D.best_path(logits, names, step))) == best
    assert len(D.best_path(logits[:0], names, step)) == 0


def test_entities_repair():
    names = D.class_names(("a", "b"))
    ix = {n: i for i, n in enumerate(names)}
    places = [(2 * i, 2 * i + 1) for i in range(8)]

    def run(labels, **kw):
        path = [ix[x] for x in labels]
        return [(e["type"], e["start"], e["end"]) for e in D.entities(path, names, places, [0.5] * 8, {"a", "b"}, "x" * 16, **kw)]

    assert run(["B-a", "I-a", "E-a", "O"]) == [("a", 0, 5)]
    assert run(["I-a", "I-a", "O"]) == [("a", 0, 3)]  # opens without a B, closed by O
    assert run(["E-a", "E-a"]) == [("a", 0, 1), ("a", 2, 3)]
    assert run(["B-a", "I-b", "E-b"]) == [("a", 0, 1), ("b", 2, 5)]
    assert run(["B-a", "B-a"]) == [("a", 0, 1), ("a", 2, 3)]
    assert run(["S-a", "S-b"], first=10, owned_end=11) == [("a", 0, 1)]


def test_probabilities_are_softmax():
    x = np.array([[1.0, 2.0, 3.0]], np.float32)
    assert np.isclose(D.probabilities(x, np.array([2]))[0], np.exp(3) / np.exp([1, 2, 3]).sum())


@given(st.text(alphabet=" abthéin😀g", max_size=30))
def test_bpe_pieces_cover_the_text(text):
    bpe = small_bpe()
    pieces = bpe.encode(text)
    assert "".join(p.text for p in pieces) == "".join(B.byte_letters()[b] for b in text.encode())
    assert bpe.decode([p.id for p in pieces]) == "".join(p.text for p in pieces)
    for (a, b), p in zip(B.char_places(text, pieces), pieces):
        assert 0 <= a <= b <= len(text)
    assert "".join(t for t, _ in B.split_spaces(text)) == text


def test_bpe_splits_and_merges():
    assert [t for t, _ in B.split_spaces("a  b   ")] == ["a", " ", " b", "   "]
    assert [p.text for p in small_bpe().encode("the the")] == ["the", "Ġthe"]
    assert B.char_places("a the", small_bpe().encode("a the")) == [(0, 1), (2, 5)]
    letters = B.byte_letters()
    assert letters[0x20] == "Ġ" and letters[0x7F] == "ġ" and letters[0x80] == "Ģ" and letters[0xA0] == "ł" and len(set(letters.values())) == 256


def test_windows():
    assert [w[:2] for w in windows(25, 10, 2)] == [(0, 10), (8, 18), (16, 25)]
    assert [w[:2] for w in windows(11, 10, 2)] == [(0, 10), (8, 11)] and windows(10, 10, 2) == [(0, 10, 10)] and windows(0, 10, 2) == []


def test_model_spans_do_not_depend_on_windows():
    names = D.class_names()

    def score(ids):
        out = np.zeros((len(ids), len(names)), np.float32)
        out[:, 0] = 1
        for i, x in enumerate(ids):
            if x == small_bpe().vocab["Ġthe"]:
                out[i, names.index("S-secret")] = 5
        return out

    text = "of the man the end" * 5
    whole = spans_of(text, small_bpe(), score, {"secret"})
    assert [s["text"] for s in whole] == ["the"] * 10
    assert spans_of(text, small_bpe(), score, {"secret"}, size=12, overlap=4) == whole
    assert spans_of(text, small_bpe(), score, {"private_url"}) == []


@pytest.mark.parametrize("given_, expected", [
    ({"verbose_logging": True}, {"logging_enabled": True, "settings_version": 2}),
    ({"verbose_logging": True, "logging_enabled": False}, {"logging_enabled": False, "settings_version": 2}),
    ({"settings_version": 2, "x": 1}, {"settings_version": 2, "x": 1}),
    ({"settings_version": 7, "verbose_logging": 1}, {"settings_version": 7, "verbose_logging": 1}),
    ([1], {"settings_version": 2}), (None, {"settings_version": 2}),
])
def test_migrate(given_, expected):
    assert cfg.migrate(given_) == expected


def test_pieces_counted_at_once_are_those_of_a_merge_at_a_time():
    from maskweave.functions.bpe import Bpe, byte_letters

    def one_by_one(bpe, word):
        parts = list(word)
        while True:
            found = [(bpe.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in bpe.ranks]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(3)
    merges = [("a", "a"), ("t", "h"), ("aa", "a"), ("th", "e"), ("Ġ", "the"), ("aa", "aa"), ("Ã", "©")]
    other = Bpe({p: i for i, p in enumerate(byte_letters().values())}, merges)
    for bpe in (small_bpe(), other):
        assert bpe.in_rank_order()
        for n in range(40):
            texts = ["".join(rnd.choice(["a", "a", "the", "th", "e", " ", "  ", "é", "er", "ing", "\n", "😀"]) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 6))] + [None, "", " ", "   ", "aaaaa  "][: n % 6]
            lengths = [bpe.lengths(t) for t in texts]
            assert [tuple(r) for r in bpe.counted(texts)] == [(len(x), x.sum(), (x > 1).sum()) for x in lengths]
            for t in filter(None, texts):
                word = "".join(byte_letters()[b] for b in t.encode())
                assert bpe.merge(word) == one_by_one(bpe, word)
    assert not Bpe({}, [("ab", "c"), ("a", "b")]).in_rank_order()
