"""Byte-level BPE with character offsets, for a model whose text is split at spaces only."""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """Byte to letter: printable Latin-1 bytes as they are, the others from U+0100 on in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Piece:
    id: int
    text: str
    byte_start: int
    byte_end: int


def split_spaces(text: str) -> list[tuple[str, int]]:
    """(piece, start in code points): a word takes one space before it along, further
    spaces are pieces of their own, and spaces at the end stay together."""
    out: list[tuple[str, int]] = []
    at, n = 0, len(text)
    while at < n:
        word = at
        while word < n and text[word] == " ":
            word += 1
        if word == n:
            out.append((text[at:], at))
            break
        out += [(" ", i) for i in range(at, word - 1)]
        begin = max(at, word - 1)
        end = text.find(" ", word)
        end = n if end < 0 else end
        out.append((text[begin:end], begin))
        at = end
    return out


class Bpe:
    """``vocab``: piece to id. ``merges``: pairs in order of rank. Words up to 64 bytes are remembered, up to ``remembered`` of them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], remembered: int = 100_000):
        self.vocab = vocab
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self._words: dict[str, tuple[list[int], list[str], np.ndarray]] = {}
        self._remembered = remembered

    def merge(self, word: str) -> list[str]:
        """A byte-mapped word merged pair by pair: the least rank first, the leftmost of equal ones.

        Pairs that can merge wait in a heap by rank and place, so a long word takes no round over all of it for each merge."""
        ranks = self.ranks
        heap = [(rank, i) for i, p in enumerate(zip(word, word[1:])) if (rank := ranks.get(p)) is not None]
        parts: list[str | None] = list(word)
        if not heap:
            return parts
        heapify(heap)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j == n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heappush(heap, (rank, i))
            if before[i] >= 0 and (rank := ranks.get((parts[before[i]], parts[i]))) is not None:
                heappush(heap, (rank, before[i]))
        return [p for p in parts if p is not None]

    def _word(self, raw: str) -> tuple[list[int], list[str], np.ndarray]:
        """Ids, pieces and their lengths in bytes of a piece of text."""
        found = self._words.get(raw)
        if found is None:
            letters = byte_letters()
            parts = self.merge("".join(letters[b] for b in raw.encode()))
            found = [self.vocab.get(p, 0) for p in parts], parts, np.array([len(p) for p in parts], np.int64)
            if len(raw) <= 64:
                if len(self._words) >= self._remembered:
                    self._words.clear()
                self._words[raw] = found
        return found

    def lengths(self, text: str | None) -> np.ndarray:
        """The pieces' lengths in bytes, in order; none for null."""
        found = [self._word(raw)[2] for raw, _ in split_spaces(text or "")]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def in_rank_order(self) -> bool:
        """Whether no merge makes a pair of lower rank, so that all places of one may be merged before the next one's."""
        made: dict[str, int] = {}
        for (a, b), rank in self.ranks.items():
            made.setdefault(a + b, rank)
        return all(made.get(part, -1) < rank for pair, rank in self.ranks.items() for part in pair)

    def counted(self, texts: list[str | None]) -> np.ndarray:
        """Rows (pieces, bytes, pieces of more than a byte) of texts: all words at once, a round over the bytes for
        each merge, so this is for encoders with few merges, ``in_rank_order``."""
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        out = np.zeros((len(raw), 3), np.int64)
        out[:, 1] = sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return out
        text = np.repeat(np.arange(len(raw)), sizes)
        first = np.zeros(len(data), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        # a piece begins with a text and with each space, but spaces at a text's end stay together
        space = data == 0x20
        begins = first | space
        for end, bare in ((e, len(r.rstrip(b" "))) for e, r in zip(np.cumsum(sizes), raw) if r.endswith(b" ")):
            begins[end - len(raw[text[end - 1]]) + bare + 1 : end] = False
        ids = {letter: b for b, letter in byte_letters().items()}
        names = data.astype(np.int32)
        place = np.arange(len(data))
        for a, b in self.ranks:
            new = ids.setdefault(a + b, len(ids))
            if a not in ids or b not in ids:
                continue
            at = np.flatnonzero((names[:-1] == ids[a]) & (names[1:] == ids[b]) & ~begins[1:])
            if a == b and len(at):  # in a run every other pair, from the left
                run = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if len(at):
                names[at] = new
                keep = np.ones(len(names), bool)
                keep[at + 1] = False
                names, begins, place = names[keep], begins[keep], place[keep]
        owner = text[place]
        out[:, 0] = np.bincount(owner, minlength=len(raw))
        out[:, 2] = np.bincount(owner[np.diff(np.append(place, len(data))) > 1], minlength=len(raw))
        return out

    def encode(self, text: str) -> list[Piece]:
        """Pieces with byte places in the UTF-8 text; unknown pieces have id 0."""
        out, at = [], 0
        for raw, _ in split_spaces(text):
            for i, part in zip(*self._word(raw)[:2]):
                out.append(Piece(i, part, at, at + len(part)))
                at += len(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces of ids joined; the byte letters stay."""
        names = {i: p for p, i in self.vocab.items()}
        return "".join(names.get(i, "") for i in ids)


def char_places(text: str, pieces: list[Piece]) -> list[tuple[int, int]]:
    """Start and end of each piece in code points, without the space in front of a word."""
    to_char = []
    for i, c in enumerate(text):
        to_char += [i] * len(c.encode())
    to_char.append(len(text))
    last = len(to_char) - 1
    space = byte_letters()[0x20]
    out = []
    for p in pieces:
        start, end = to_char[min(p.byte_start, last)], to_char[min(p.byte_end, last)]
        if p.text.startswith(space) and start < end:
            start += 1
        out.append((start, end))
    return out
