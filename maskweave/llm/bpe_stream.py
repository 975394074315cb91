"""Byte-level BPE as a bounded-lookahead transducer, and back by a byte-to-text state machine.

Encoding reads a text in blocks and emits a token's id once no further text can
change it; it never holds more than a block and the lookahead.

*Pieces.* The splitter's matches in a block are final but for those at its end:
a match is kept back while it may grow, or while a contraction may still begin
where it does. What ends before that is looked up or merged at once.

*Inside a piece.* A piece longer than a block (a run of letters, digits, signs or
white space) is merged in a window. Let d be the last boundary up to which two
continuations of the window agree. It moves left in the step of rule r = (u, v)
only if u ends at d and v starts there in one of them, and then by the length of
u; what starts at the new d is uv or u, and only grows by later rules. The
longest such chain of rules of rising rank is the merge list's sufficient
lookahead (``lookahead``): tokens that end further than that from the window's
end are final. It is worked out from the list in one pass from its end.

*Decoding* joins the bytes of ids and gives out characters as they become whole;
at most three bytes wait. Bytes that are no UTF-8 become U+FFFD, as the library has it.

The splitter's classes come from the library: code points of which the regular
expressions' tables may know better are looked up in it once, and stand in the
split for a plain letter, digit or sign of the library's class.

Cases: a null or empty text has no tokens and decodes to an empty text; strings
of added tokens inside a text are those tokens, as is the library's default; ids
that the vocabulary lacks decode to nothing; repeated rows and ids are encoded
each; an empty table gives an empty result; other input columns are not read.
"""
from __future__ import annotations

import codecs
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import small_batches, table
from maskweave.llm.files import releasing
from maskweave.llm.token_records import tokenizer_path
from maskweave.storage import compacted

#: Characters of a block; pieces up to SHORT characters are remembered, up to REMEMBERED of them.
BLOCK, SHORT, REMEMBERED = 1 << 16, 48, 400_000
#: Rows that go to Python at a time, and ids that are decoded at a time.
ROWS, IDS = 500, 1 << 16
#: The byte-level splitter, as the tokenizer file's kind of splitter has it: fixed.
_SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs that a piece may be, to go on with in the next block.
_RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]
#: Code points up to here have the same class in all versions of the tables.
_OLD = regex.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, for the rest U+0100 on in byte order."""
    shown = set(chain(range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int | None:
    """Letters that must follow a boundary for it to be final; None if the list has a
    rule whose parts may come into being after it, so that ranks don't order the steps."""
    made: dict[str, int] = {}
    for i, (u, v) in enumerate(merges):
        made[u + v] = i  # the last rule that makes it
    if any(len(x) > 1 and made.get(x, -1) >= i for i, pair in enumerate(merges) for x in pair):
        return None
    best: dict[str, int] = {}  # token at a boundary: how far rules after the current one can still push it left
    most = 0
    for u, v in reversed(merges):
        joined, alone = best.get(u + v, 0), best.get(u, 0)
        step = len(u) + max(joined, alone)
        best[u] = max(alone, joined)
        best[v] = max(best.get(v, 0), step)
        most = max(most, step)
    return most


class Merges:
    """A vocabulary and its merge list over letters that stand for bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.lookahead = vocab, lookahead(merges)
        self.ranks = {pair: i for i, pair in enumerate(merges)}

    def parts(self, letters: str) -> list[str]:
        """Tokens of a whole piece: the least rank first, the leftmost of equal ones."""
        return self._scanned(list(letters)) if len(letters) <= SHORT else self._queued(letters)

    def _scanned(self, parts: list[str]) -> list[str]:
        of, last = self.ranks.get, len(self.ranks)
        ranks = [of(pair, last) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < last:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = of((parts[at - 1], parts[at]), last)
            if at < len(ranks):
                ranks[at] = of((parts[at], parts[at + 1]), last)
        return parts

    def _queued(self, letters: str) -> list[str]:
        """The same with a queue of candidates: n log n for long pieces."""
        part: list[str | None] = list(letters)
        n, ranks = len(part), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, x, y) for i, (x, y) in enumerate(zip(letters, letters[1:])) if (r := ranks.get((x, y))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, x, y = heapq.heappop(queue)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j], after[i] = x + y, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get((x + y, part[after[j]]))) is not None:
                    heapq.heappush(queue, (r, i, x + y, part[after[j]]))
            if before[i] >= 0 and (r := ranks.get((part[before[i]], x + y))) is not None:
                heapq.heappush(queue, (r, before[i], part[before[i]], x + y))
        return [p for p in part if p is not None]


class Window:
    """The transducer inside one piece: letters in, final tokens out."""

    def __init__(self, merges: Merges, width: int):
        self._m, self._open, self._width = merges, "", width

    def push(self, letters: str) -> list[str]:
        self._open += letters
        ahead = self._m.lookahead
        if ahead is None or len(self._open) < self._width + ahead:
            return []
        final, end, at = [], len(self._open) - ahead, 0
        for p in self._m.parts(self._open):
            if at + len(p) > end:
                break
            final.append(p)
            at += len(p)
        self._open = self._open[at:]
        return final

    def end(self) -> list[str]:
        held, self._open = self._open, ""
        return self._m.parts(held) if held else []


class Encoder(dict):
    """Texts to packed ids (little-endian, 32 bits). As a dictionary: short pieces and their packed ids."""

    def __init__(self, path: str, block: int = BLOCK, limit: int = REMEMBERED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m, split = d["model"], d["pre_tokenizer"] or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        if m["type"] != "BPE" or d["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or any((m.get(k) or v) != v for k, v in plain.items()):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take neighbours along")
        self.merges = Merges(m["vocab"], [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in m["merges"]])
        self.added = {t["content"]: np.uint32(t["id"]).tobytes() for t in d["added_tokens"]}
        self._letters = dict(enumerate(byte_letters()))
        self._ids = {p: np.array([i], "<u4").tobytes() for p, i in m["vocab"].items()}
        self._block, self._limit = block, limit
        # the longest string first where several begin at one place, as the library matches them
        self._marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._wait = max(map(len, self.added), default=1) - 1
        self._library, self._stand_ins, self._known = Tokenizer.from_file(path).pre_tokenizer, {}, set()

    def __missing__(self, piece: str) -> bytes:
        ids = self._packed(self.merges.parts(self._lettered(piece)))
        if len(piece) <= SHORT:
            if len(self) >= self._limit:
                self.clear()
            self[piece] = ids
        return ids

    def _lettered(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self._letters)

    def _packed(self, parts: Iterable[str]) -> bytes:
        return b"".join(map(self._ids.__getitem__, parts))

    def _shown(self, text: str) -> str:
        """``text`` as the splitter sees it: of the same length, classes as in the library."""
        if not _OLD.search(text):
            return text
        for c in set(text) - self._known:
            self._known.add(c)
            if c > "ɏ":
                begins = [at for _, (at, _) in self._library.pre_tokenize_str(f"a{c}1{c}!{c} ")]
                # side by side with a letter, a digit or a sign it is one piece with its like
                of = "x" if 1 not in begins else "2" if 3 not in begins else "#" if 5 not in begins else " "
                if not _RUNS["x2# ".index(of)].fullmatch(c):
                    self._stand_ins[ord(c)] = of
        return text.translate(self._stand_ins) if self._stand_ins else text

    def _pieces(self, text: str) -> Iterable[str]:
        shown = self._shown(text)
        return _SPLIT.findall(text) if shown is text else (text[slice(*m.span())] for m in _SPLIT.finditer(shown))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(self.stream(text[i : i + self._block] for i in range(0, len(text), self._block)))

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text that comes in blocks, as they become final."""
        ahead = iter(blocks)
        block = next(ahead, None)
        open_text = open_mark = ""
        window: tuple[Window, int] | None = None  # a piece longer than a block, and its kind
        while block is not None:
            after = next(ahead, None)
            open_mark, block = "", open_mark + block
            if after is not None and self._wait:  # an added token's string may go on in the next block
                open_mark, block = block[-self._wait :], block[: -self._wait]
                # a string that begins in time is taken whole
                if (m := self._straddles(block, open_mark)) is not None:
                    block, open_mark = block + open_mark[:m], open_mark[m:]
            at = 0
            for mark in self._marks.finditer(block) if self._marks else ():
                out, open_text, window = self._final(open_text, block[at : mark.start()], window, True)
                yield out
                yield self.added[mark[0]]
                at = mark.end()
            out, open_text, window = self._final(open_text, block[at:], window, after is None)
            yield out
            block = after

    def _straddles(self, block: str, held: str) -> int | None:
        """Where in ``held`` an added token's string ends that begins in ``block``."""
        if self._marks is None:
            return None
        n = len(block)
        for m in self._marks.finditer(block + held):
            if m.start() < n < m.end():
                return m.end() - n
        return None

    def _final(self, open_text: str, more: str, window: tuple[Window, int] | None, last: bool) -> tuple[bytes, str, tuple[Window, int] | None]:
        """Ids that are final, the text that is not, and the long piece that is open."""
        out, text = [], open_text + more
        if window is not None:
            w, kind = window
            shown = self._shown(text)
            end = _RUNS[kind].match(shown).end()
            ended = end < len(text)
            if kind == 3 and (ended or not last):  # the last white space may belong to what follows
                end = max(0, end - 1)
            out += w.push(self._lettered(text[:end]))
            text = text[end:]
            if not (ended or last):
                return self._packed(out), text, window
            out += w.end()
        head = self._packed(out)
        if last:
            return head + b"".join(map(self.__getitem__, self._pieces(text))), "", None
        shown, n, final = self._shown(text), len(text), []
        open_at = n
        for m in _SPLIT.finditer(shown):
            if m.end() == n or m.start() + 3 > n:
                open_at = m.start()
                break
            final.append(m.span())
        ids = head + b"".join(self[text[a:b]] for a, b in final)
        held = text[open_at:]
        if len(held) <= SHORT:
            return ids, held, None
        begin = 1 if held[0] == " " and not held[:2].isspace() else 0
        kind = next(k for k, r in enumerate(_RUNS) if r.fullmatch(shown[open_at + begin :]))
        w = Window(self.merges, self._block)
        keep = 1 if kind == 3 else 0
        return ids + self._packed(w.push(self._lettered(held[: len(held) - keep]))), held[len(held) - keep :], (w, kind)


class Decoder:
    """Packed ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        names = {i: p for p, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self._bytes = [b""] * (max(names) + 1)
        for i, p in names.items():
            self._bytes[i] = bytes(map(bytes_of.__getitem__, p)) if all(c in bytes_of for c in p) else p.encode()

    def stream(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that come in blocks, as its characters become whole."""
        machine, n = codecs.getincrementaldecoder("utf-8")("replace"), len(self._bytes)
        for block in blocks:
            ids = np.frombuffer(block, "<u4")
            yield machine.decode(b"".join(map(self._bytes.__getitem__, ids[ids < n].tolist())))
        yield machine.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(ids[i : i + 4 * IDS] for i in range(0, len(ids), 4 * IDS)))


_ENCODERS: dict[str, Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, and ids as packed little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = [e.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    return docs.select(id_col, text).mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``ids`` and, in the last column, their text (``decoded``)."""
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(path)
        for batch in batches:
            texts = [d.decode(x.as_py() or b"") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(releasing(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string")


def op11_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts with digests of the ids and of the text that they decode to."""
    path = tokenizer_path("byte_bpe_50k.json")
    with small_batches(spark, ROWS):
        both = decode(encode(table(spark, sf_dir, "documents"), path), path)
        digests = both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
        return compacted(digests, "bpe-digests")


QUERIES = {"op11_bpe_stream": op11_bpe_stream}
