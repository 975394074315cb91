"""Token counts, with huge documents cut into overlapping chunks.

Two neighbouring characters that stand side by side in no vocabulary piece can
never end up in one token, whatever the merges around them: a text may be cut
between them and its parts counted on their own. Such a cut is proven stable.

Texts are cut at the stable cuts before spaces and line ends into units, which a
bounded cache counts once. A text longer than ``CHUNK`` is first encoded in
chunks that overlap, with the offsets of their tokens; neighbours are spliced at
the first stable cut in their overlap that both place at a token's edge, and the
overlap is doubled as long as there is none. A text without any stable cut ends
up as one chunk, and its count is still the library's.

Cases: a null or empty text has no tokens; special strings in a text are plain
text, as is the library's default; repeated rows are counted each; an empty
table gives an empty result; columns other than the id and the text are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from maskweave.llm.common import table
from maskweave.llm.token_records import tokenizer_path

CHUNK, OVERLAP = 32_768, 256
CACHED_UNITS = 400_000
MARK = "▁"
_UNITS = re.compile(r"\n[^ \n]*| *[^ \n]+| +")


class PieceCounter:
    """Counts of a sentencepiece model whose normaliser changes nothing but spaces."""

    def __init__(self, path: str, limit: int = CACHED_UNITS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._limit = limit
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        seen = {c for p in pieces for c in p}
        # what the unit cuts rest on: no piece goes on with a space after something else, or holds a line end
        self.by_units = "\n" not in seen and not any(x[1] == MARK and x[0] != MARK for x in self.pairs)
        self._led: dict[str, int] = {"": 1}
        self._lines: dict[str, int] = {}

    def encode_len(self, text: str) -> int:
        return len(self.sp.encode(text, num_threads=1))

    def stable(self, text: str, i: int) -> bool:
        """Whether no token can reach over position i."""
        pair = text[i - 1 : i + 1].replace(" ", MARK)
        return pair not in self.pairs

    def _unit(self, unit: str) -> int:
        """Tokens of a unit that a space leads; the library adds that space itself."""
        n = self._led.get(unit)
        if n is None:
            n = self.encode_len(unit)
            if len(unit) <= 64:
                if len(self._led) >= self._limit:
                    self._led = {"": 1}
                self._led[unit] = n
        return n

    def _line(self, unit: str) -> int:
        """Tokens of a unit that starts with a line end; the space that the library adds stays a token."""
        n = self._lines.get(unit)
        if n is None:
            n = self.encode_len(unit) - 1
            if len(unit) <= 64:
                if len(self._lines) >= self._limit:
                    self._lines = {}
                self._lines[unit] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not self.by_units:
            return self.encode_len(text)
        if MARK in text:
            text = text.replace(MARK, " ")
        led, line = self._unit, self._line
        if text[0] != " " and "  " not in text:
            get, n = self._led.get, 0
            for part in text.split(" "):
                if "\n" in part:
                    head, *rest = part.split("\n")
                    n += led(head) + sum(line("\n" + x) for x in rest)
                else:
                    n += get(part) or led(part)
            return n
        units = _UNITS.findall(text)
        # the library's own space comes before the first unit, so that one keeps its spaces
        n = line(units[0]) + 1 if units[0][0] == "\n" else self.encode_len(units[0])
        for u in units[1:]:
            n += line(u) if u[0] == "\n" else led(u[1:])
        return n

    # -- huge texts ------------------------------------------------------------

    def edges(self, chunk: str) -> dict[int, int]:
        """Position to tokens before it, for the token edges of a chunk."""
        out: dict[int, int] = {}
        places = self.sp.encode(chunk, return_type="offset_mapping")["offsets"]
        for n, (begin, _) in enumerate(places):
            out.setdefault(begin, n)  # the bytes of one character share its position
        out[len(chunk)] = len(places)
        return out

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The same, by chunks of about ``chunk`` characters."""
        text = text.replace(MARK, " ")
        total, begin = 0, 0  # begin: a stable cut; what lies before it is counted
        end = min(len(text), chunk)
        at = self.edges(text[:end])
        origin = base = 0  # of the current chunk: where it starts, and its tokens before ``begin``
        while end < len(text):
            widen = overlap
            while True:
                start = max(begin, end - widen)
                after_end = min(len(text), start + chunk + widen)
                after = self.edges(text[start:after_end])
                cut = next((i for i in range(start + 1, end) if i > begin and i - origin in at and i - start in after and self.stable(text, i)), None)
                if cut is not None or start == begin:
                    break
                widen *= 2  # alignment failed
            if cut is None:  # no common cut since the last one: one longer chunk instead
                chunk, end = 2 * chunk, min(len(text), begin + 2 * chunk)
                if begin == 0:
                    at, origin, base = self.edges(text[:end]), 0, 0
                else:
                    at, origin, base = self._from_cut(text, begin, end)
                continue
            total += at[cut - origin] - base
            at, origin, base, begin, end = after, start, after[cut - start], cut, after_end
        return total + at[len(text) - origin] - base

    def _from_cut(self, text: str, begin: int, end: int) -> tuple[dict[int, int], int, int]:
        """Edges of text[begin:end] where begin is a stable cut: a character more in front, so the cut is inside."""
        start = begin - 1
        at = self.edges(text[start:end])
        if 1 in at:
            return at, start, at[1]
        raise ValueError("a stable cut is no token edge")


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            sizes, counts = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                sizes.append(len(t.encode()))
                counts.append(c.count_huge(t) if len(t) > CHUNK else c.count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op9_token_counts": op9_token_counts}
