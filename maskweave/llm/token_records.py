"""Token ids as length-delimited binary records, with an offset index.

A record is a document's ids: an 8-byte little-endian length, the masked
checksum of those 8 bytes, the ids, and their masked checksum. The mask is the
usual rotate-and-add one for checksums stored beside what they cover; the
checksum is CRC-32, as the standard library has it. Ids take two bytes where
the vocabulary allows, else four. An index file beside each data file holds
(doc_id, offset, tokens) triples, so a reader can take records in any order.

Documents are range-partitioned and sorted by id, so files follow one another by
the id of their first record; equal ids are in one file. The tokenizer's normaliser and splitter never look across a space,
so a text's ids are those of its space-separated words; a bounded cache holds them.

Cases: a null or empty text gives the end id alone; null ids come first; rows
with the same id are ordered by text, so repeated rows are each written; an
empty table writes nothing; other input columns are not read.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import small_batches, table
from maskweave.llm.files import PartFile, open_input, open_random, releasing
from maskweave.storage import compacted, fresh_path

MASK_DELTA = 0xA282EAD8
CACHED_WORDS = 400_000
#: Texts that are Python strings at a time; and bytes of files that a task reads back.
ROWS, READ_BYTES = 256, 16 << 20
_HEAD, _SUM, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qQQ")
#: doc_id of a null in the index
NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload; None at the end. Damage raises."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or _SUM.unpack_from(head, 8)[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = _HEAD.unpack_from(head)[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or _SUM.unpack_from(body, n)[0] != masked(body[:n]):
        raise ValueError("a record's payload is damaged")
    return bytes(body[:n])


def entry(doc_id: int | None, at: int, n: int) -> bytes:
    return _ENTRY.pack(NO_ID if doc_id is None else doc_id, at, n)


def read_entry(stream) -> tuple[int | None, int, int]:
    doc_id, at, n = _ENTRY.unpack(stream.read(_ENTRY.size))
    return None if doc_id == NO_ID else doc_id, at, n


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that byte-level models use for it: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Characters whose normal form, lower case and class need no tables: ASCII and Latin letters.
_SIMPLE = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]*")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u017f"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


class WordEncoder(dict):
    """Word to packed ids, by the library, for words of a text split at spaces and line ends.

    The library normalises and splits every word anew, which costs far more than
    its merges. Words of simple characters are lower-cased and split here, and
    only the pieces go to the library's model; all others go through all of it."""

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok, self._limit = Tokenizer.from_file(path), limit
        self._tok.no_truncation()
        self._tok.no_padding()
        self.dtype = np.dtype("<u2" if self._tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._model, self._letters, self._pieces = self._tok.model, _byte_letters(), {}
        self._old: dict[str, bytes] = {}
        # the short way holds for one kind of tokenizer; it is tried on words of every sort
        probe = ["Don't", "ÉTÉ", "a1b22", "x--y''s", "naïve,", "'LL", "&&&", "Ð×÷ß", "I'm", "w" * 40, "$9.99"]
        self._short = all(self._quick(w) == self._whole(w) for w in probe)
        self[""] = b""

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _whole(self, word: str) -> bytes:
        return self._pack(self._tok.encode(word, add_special_tokens=False).ids)

    def _quick(self, word: str) -> bytes:
        return b"".join(map(self._piece, _PIECES.findall(word.lower())))

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else "".join(map(self._letters.__getitem__, piece.encode()))
            ids = self._pack([t.id for t in self._model.tokenize(letters)])
            if len(self._pieces) >= self._limit // 2:
                self._pieces.clear()
            if len(piece) <= 64:
                self._pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            ids = self._quick(word) if self._short and _SIMPLE.fullmatch(word) and "<|" not in word else self._whole(word)
        if len(self) >= self._limit:  # the words of two generations are held, so common ones stay
            self._old = dict(self)
            self.clear()
            self[""] = b""
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write ``docs``; a row (first_id, uri, index_uri, token_bytes, n_docs, n_tokens) for each data file, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = index = None
        n_docs = n_tokens = 0
        first = None
        words = encoder(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out, index, first = PartFile(folder, ".rec"), PartFile(folder, ".idx"), i
                payload = words.encode(t or "") + end
                n = len(payload) // words.dtype.itemsize
                at = out.write(frame(payload))
                index.write(entry(i, at, n))
                n_docs, n_tokens = n_docs + 1, n_tokens + n
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"first_id": [first], "uri": [out.uri], "index_uri": [index.uri], "token_bytes": [words.dtype.itemsize], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=schema)

    schema = pa.schema([("first_id", pa.int64()), ("uri", pa.string()), ("index_uri", pa.string()), ("token_bytes", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        return compacted(ordered.mapInArrow(releasing(run), "first_id long, uri string, index_uri string, token_bytes int, n_docs long, n_tokens long"), "records")


def read_records(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, uri, offset.

    Files are few (one for each written partition), so their running totals are
    a window over one row for each file. Small files are read several to a task."""
    starts = files.withColumn("first", F.coalesce(F.sum("n_tokens").over(W.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n_bytes, n_files = files.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("token_bytes")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, min(n_files, -(-n_bytes // READ_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                dtype, start, rows = np.dtype(f"<u{f['token_bytes']}"), f["first"], []
                with open_input(f["uri"]) as data, open_input(f["index_uri"]) as index:
                    while (payload := read_frame(data)) is not None:
                        doc_id, at, n = read_entry(index)
                        ids = np.frombuffer(payload, dtype)
                        if len(ids) != n:
                            raise ValueError("the index does not fit its records")
                        rows.append((doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes()), f["uri"], at))
                        start += n
                        if len(rows) == 20_000:
                            yield _batch(rows, schema)
                            rows = []
                yield _batch(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("uri", pa.string()), ("offset", pa.int64())])
    return starts.select("uri", "index_uri", "token_bytes", "first").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, uri string, offset long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_index(uri: str) -> list[tuple[int, int, int]]:
    with open_input(uri) as stream:
        return list(_ENTRY.iter_unpack(stream.read()))


def read_at(uri: str, offset: int, token_bytes: int) -> np.ndarray:
    """The ids of one record, by its offset: a shuffled read."""
    with open_random(uri) as f:
        f.seek(offset)
        return np.frombuffer(read_frame(f), f"<u{token_bytes}")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_records(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"))
    return read_records(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written as records; a row for each with its place."""
    files = write_records(docs, fresh_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"))
    return read_records(files).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_token_records": op5_token_records}
