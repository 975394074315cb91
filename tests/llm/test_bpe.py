"""The BPE transducer against the library, and its lookahead against the definition."""
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskweave.llm import bpe_stream
from maskweave.llm.token_records import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = "aZ é'sßñ  \t\n  　\x1c\x85١٣٣²½x😀👩‍👩‍👧́՘౜೜꟎\U00010940中文字日本<|endoftext|>'ll 've're'd'm't''!!--==#$_0123456789"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(e, text):
    return np.frombuffer(e.encode(text), "<u4").tolist()


def odd_text(rnd, n):
    out = []
    while sum(map(len, out)) < n:
        kind = rnd.randrange(8)
        if kind == 0:
            out.append("".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 20))))
        elif kind == 1:
            out.append(rnd.choice(["<|endoftext|>", "<|endoftext", "|endoftext|>", "'ll", "don't", " 'S"]))
        elif kind == 2:
            out.append(rnd.choice(["a", "ab", " ", "\n", "=", "7", "é", "the", "字", " ", "'"]) * rnd.randint(1, 150))
        else:
            out.append(" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 6))))
    return "".join(out)


def test_whole_texts_as_the_library(library):
    rnd, e, d = random.Random(1), bpe_stream.Encoder(PATH), bpe_stream.Decoder(PATH)
    for _ in range(300):
        t = odd_text(rnd, rnd.randint(0, 400))
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(e, t) == want, t
        assert d.decode(e.encode(t)) == library.decode(want, skip_special_tokens=False) == t


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_of_any_size_change_nothing(library, block):
    rnd = random.Random(block)
    e = bpe_stream.Encoder(PATH, block=block)
    for _ in range(60):
        t = odd_text(rnd, rnd.randint(0, 300))
        assert ids(e, t) == library.encode(t, add_special_tokens=False).ids, t


def test_a_piece_longer_than_its_window_is_let_go_in_time(library):
    e, rnd = bpe_stream.Encoder(PATH, block=256), random.Random(3)
    ahead = e.merges.lookahead
    assert 0 < ahead < 5000
    for t in ("a" * 20_000, "".join(rnd.choice("abcdefghij") for _ in range(20_000)), " " * 20_000 + "x", "=" * 9_000 + "'s", "é" * 9_000):
        held, out = 0, []
        w = bpe_stream.Window(e.merges, 256)
        letters = e._lettered(t)
        for i in range(0, len(letters), 100):
            out += w.push(letters[i : i + 100])
            held = max(held, len(w._open))
        out += w.end()
        assert out == e.merges.parts(letters) and held <= ahead + 256 + 100
        assert ids(e, t) == library.encode(t, add_special_tokens=False).ids


def drawn_merges(rnd, n):
    """A list whose parts come before what is made of them."""
    known, merges = ["a", "b", "c"], []
    for _ in range(n):
        pair = rnd.choice(known), rnd.choice(known)
        if "".join(pair) not in known and len("".join(pair)) <= 9:
            merges.append(pair)
            known.append("".join(pair))
    return merges


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_what_lies_before_the_lookahead_is_final(seed):
    rnd = random.Random(seed)
    merges = drawn_merges(rnd, rnd.randint(1, 25))
    m = bpe_stream.Merges({}, merges)
    assert m.lookahead is not None

    def edges(letters):
        at, out = 0, {0}
        for p in m.parts(letters):
            at += len(p)
            out.add(at)
        return out

    for _ in range(15):
        head = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 70)))
        limit = len(head) - m.lookahead
        tails = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(4)]
        assert len({frozenset(x for x in edges(head + t) if x <= limit) for t in tails}) == 1
        assert m._scanned(list(head)) == m._queued(head)


def test_a_list_out_of_order_has_no_lookahead():
    assert bpe_stream.lookahead([("ab", "c"), ("a", "b")]) is None and bpe_stream.lookahead([]) == 0


def test_decoding_waits_for_whole_characters(library):
    d, t = bpe_stream.Decoder(PATH), "é😀字" * 50
    packed = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
    some = list(d.stream(x.tobytes() for x in packed))
    assert "".join(some) == t and "" in some
    rnd = random.Random(5)
    for _ in range(200):  # ids in any order: bytes that are no text
        x = np.array([rnd.randrange(50_300) for _ in range(rnd.randint(0, 12))], "<u4")
        assert d.decode(x.tobytes()) == library.decode([i for i in x.tolist()], skip_special_tokens=False)


def test_rows(spark, library, tmp_path):
    texts = ["", None, "plain text", "twice", "twice", "x" * 200_000, ODD * 50, "<|endoftext|>", "é" * 70_000 + " a\n"]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe_stream.op11_bpe_stream(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe_stream.op11_bpe_stream(spark, str(tmp_path)).collect() == []
