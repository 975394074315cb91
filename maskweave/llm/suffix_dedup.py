"""Removal of byte strings of ``LENGTH`` that also start elsewhere, by suffix arrays in shards.

A shard must hold all places of a string that it judges. The least hash among
the 16-byte grams of a ``LENGTH``-byte window is the same wherever the window
stands, so windows go by that gram, their anchor. Neighbouring windows whose
anchors are equal grams form a segment; each window is in exactly one segment,
and equal windows have equal anchors. A stretch that repeats itself with a short
period (a run of one character, say) is one segment, whatever its length, and is
marked as having its anchor at several places. Segments therefore settle most of
the work by counting:

- an anchor met once, at one place: none of its windows is repeated;
- a segment met twice or more, byte for byte: all of its windows are repeated;
- an anchor with several different segments, or with one that has it at several
  places: its windows are contested. One copy of each such segment goes to the
  anchor's shard.

A shard is joined to one text, its suffix array is built by induced sorting, and
the permuted common prefixes tell which windows of a segment stand elsewhere in
the shard too. An anchor with more bytes than ``HOT`` segments have is dealt over several
shards; their distinct windows then meet by hash in buckets of bounded size.
Every group is bounded, whatever the number of copies, and nothing is dropped.

Cases: a null text counts as empty; texts under ``LENGTH`` bytes have no window
and stay; repeated rows are copies of one another; matches never cross texts;
equal windows within one text count, overlapping ones too; an empty table gives
an empty result; columns other than the id and the text are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import small_batches, table
from maskweave.llm.shingles import mix
from maskweave.llm.suffix import permuted_prefixes, suffix_array
from maskweave.storage import compacted, few, stage

LENGTH, GRAM = 400, 16
HOT, SHARD_BYTES, BUCKET_WINDOWS = 2000, 3_000_000, 200_000
_SLICE = 1 << 20
_U = np.uint64
SEPARATOR = 0xFF  # in no UTF-8 text


# -- anchors and segments -------------------------------------------------------


def _windows(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a window of ``size`` bytes: where its anchor is; and the hash of the gram at each place."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    eight = np.ndarray((n + 8,), "<u8", padded, 0, (1,))
    grams = mix(eight[: n - GRAM + 1] * _U(0x9E3779B97F4A7C15) + mix(eight[8 : n - GRAM + 9]))
    w = size - GRAM + 1
    m = len(grams)
    places = np.arange(m, dtype=_U)
    keys = (grams & ~_U((1 << 21) - 1)) | places  # the leftmost of equal ones is the least
    blocks = -(-m // w)
    full = np.full(blocks * w, np.iinfo(_U).max, _U)
    full[:m] = keys
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    count = n - size + 1
    least = np.minimum(ahead[:count], behind[w - 1 : w - 1 + count])
    return (least & _U((1 << 21) - 1)).astype(np.int64), grams.view(np.int64)


def segments(data: np.ndarray, bounds: np.ndarray, size: int = LENGTH) -> Iterator[tuple[int, int, int, int, bool]]:
    """(text, start, end, anchor, at several places) for the segments of the texts data[bounds[i]:bounds[i+1]]."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _SLICE, "right")) - 1)
        lo, hi = int(bounds[i]), int(bounds[j])
        for part in range(lo, max(lo + 1, hi - size + 1), _SLICE) if j == i + 1 else [lo]:
            end = min(hi, part + _SLICE + size - 1) if j == i + 1 else hi
            if end - part >= size:
                yield from _segments(data[part:end], part, bounds[i : j + 1], i, size)
        i = j


def _segments(data: np.ndarray, origin: int, bounds: np.ndarray, first: int, size: int) -> Iterator[tuple[int, int, int, int, bool]]:
    places, grams = _windows(data, size)
    n, anchors = len(places), grams[places]
    at = np.arange(n) + origin
    text = np.searchsorted(bounds, at, "right") - 1
    inside = at + size <= bounds[text + 1]
    new = np.ones(n, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return
    # a segment ends before the next start or where windows no longer fit
    breaks = np.flatnonzero(new | ~inside)
    ends = np.append(breaks, n)[np.searchsorted(breaks, starts, "right")] - 1
    own = text[starts]
    base = bounds[own]
    several = places[starts] != places[ends]
    yield from zip((own + first).tolist(), (starts + origin - base).tolist(), (ends + origin - base + size).tolist(), anchors[starts].tolist(), several.tolist())


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


_SEGMENTS = pa.schema([("text_key", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("anchor", pa.int64()), ("digest", pa.binary()), ("inner", pa.bool_())])


def segment_rows(docs: DataFrame, size: int) -> DataFrame:
    """A row for each segment of ``docs`` (text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                data, bounds = _buffers(batch.column(1))
                rows = list(segments(data, bounds, size))
                if not rows:
                    continue
                own, start, stop, anchor, inner = map(list, zip(*rows))
                view = memoryview(data)
                first = bounds.tolist()
                digests = [hashlib.blake2b(view[first[o] + a : first[o] + b], digest_size=16).digest() for o, a, b in zip(own, start, stop)]
                keys = batch.column(0).take(pa.array(own, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(anchor, pa.int64()), pa.array(digests, pa.binary()), pa.array(inner, pa.bool_())], schema=_SEGMENTS)

    return docs.select("text_key", "text").mapInArrow(run, "text_key binary, start int, stop int, anchor long, digest binary, inner boolean")


# -- shards ---------------------------------------------------------------------


def _hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows at ``at``, from running polynomials."""
    out = []
    for base in (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F):
        n = len(data)
        power = np.full(n + 1, base, _U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), _U)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        table = mix(np.arange(256, dtype=_U) + _U(base & 0xFFFF))
        sums = np.zeros(n + 1, _U)
        np.cumsum(table[data] * power[:n], out=sums[1:])
        out.append(mix((sums[at + size] - sums[at]) * inverse[at]))
    return out[0], out[1]


def repeated_windows(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of different segments laid end to end: the joined text, each window's
    place, its segment, whether it stands twice, and whether it is the first of its kind in the array."""
    data = np.frombuffer(bytes([SEPARATOR]).join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    sa = suffix_array(data)
    prefix, before = permuted_prefixes(data, sa)
    long = prefix >= size
    twice = long.copy()
    twice[before[long]] = True
    counts = lengths - size + 1
    own = np.repeat(np.arange(len(parts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[own]
    return data, at, own, twice[at], ~long[at]


def _runs(flags: np.ndarray) -> list[int]:
    """start, stop, start, stop ... of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


_VERDICT = "anchor long, digest binary, runs array<int>, bucket int, hashes binary, places binary"
_VERDICTS = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("runs", pa.list_(pa.int32())), ("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])


def judge_shard(rows: pa.Table, size: int) -> pa.Table:
    """Verdict rows of the segments of one shard: runs of repeated windows by segment; for
    anchors that have other shards too, their distinct windows by bucket."""
    seen, parts, keys, spread = set(), [], [], []
    for anchor, digest, part, buckets in zip(*(rows.column(c).to_pylist() for c in ("anchor", "digest", "part", "buckets"))):
        if (anchor, digest) not in seen:
            seen.add((anchor, digest))
            keys.append((anchor, digest))
            parts.append(part)
            spread.append(buckets)
    data, at, own, twice, first = repeated_windows(parts, size)
    out = []
    edges = np.searchsorted(own, np.arange(len(parts) + 1))
    for s, (anchor, digest) in enumerate(keys):
        runs = _runs(twice[edges[s] : edges[s + 1]])
        if runs:
            out.append({"anchor": anchor, "digest": digest, "runs": runs})
    hot = np.array([b > 0 for b in spread])
    if hot.any():
        pick = np.flatnonzero(hot[own] & first)
        h1, h2 = _hashes(data, at[pick], size)
        anchors = np.array([k[0] for k in keys], np.int64)[own[pick]]
        bucket = (h2 % np.array(spread, _U)[own[pick]]).astype(np.int64)
        offset = pick - edges[own[pick]]
        order = np.lexsort((bucket, anchors))
        cuts = np.flatnonzero(np.concatenate([[True], (anchors[order][1:] != anchors[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])]))
        for group in np.split(order, cuts[1:]):
            who = b"".join(keys[s][1] for s in own[pick[group]].tolist())
            places = np.where(twice[pick[group]], -1, offset[group]).astype("<i4")
            out.append({"anchor": int(anchors[group[0]]), "bucket": int(bucket[group[0]]), "hashes": np.stack([h1[group], h2[group]], 1).astype("<u8").tobytes(), "places": places.tobytes() + who})
    return pa.Table.from_pylist(out, schema=_VERDICTS)


def meet_bucket(rows: pa.Table, size: int) -> pa.Table:
    """Windows of one anchor and bucket from its shards: runs of those that stand in several.

    Within a shard each window comes once, so equal hashes are of different shards."""
    hashes = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), "<u8").reshape(-1, 2)
    places, who = [], []
    for blob in rows.column("places").to_pylist():
        n = len(blob) // 20
        places.append(np.frombuffer(blob[: 4 * n], "<i4"))
        who.append(np.frombuffer(blob[4 * n :], "V16"))
    places, who = np.concatenate(places), np.concatenate(who)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    same = (hashes[order][1:] == hashes[order][:-1]).all(axis=1)
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    by: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(twice & (places >= 0)).tolist():
        by.setdefault(who[i].tobytes(), []).append(int(places[i]))
    anchor = rows.column("anchor")[0].as_py()
    out = [{"anchor": anchor, "digest": d, "runs": [x for p in sorted(at) for x in (p, p + 1)]} for d, at in by.items()]
    return pa.Table.from_pylist(out, schema=_VERDICTS)


# -- the plan -------------------------------------------------------------------


def _cut(docs: DataFrame) -> DataFrame:
    """(anchor, digest, shard, buckets, part) from ``docs`` (text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("shard", pa.int64()), ("buckets", pa.int32()), ("part", pa.binary())])
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                out += [{"anchor": w["anchor"], "digest": w["digest"], "shard": w["shard"], "buckets": w["buckets"], "part": data[w["start"] : w["stop"]]} for w in wanted]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select("text", "wanted").mapInArrow(run, "anchor long, digest binary, shard long, buckets int, part binary")


def repeated_spans(docs: DataFrame, size: int = LENGTH) -> DataFrame:
    """(text_key, start, stop, runs) of the segments of ``docs`` (text_key, text) with repeated
    windows: runs of window places within the segment, start and stop by turns; null: all."""
    with small_batches(docs.sparkSession):
        found = stage(segment_rows(docs, size), "segments")
    live = compacted(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where("n > 1 OR inner").select("anchor"), "anchors")
    # live anchors grow with the corpus: joined by shuffle at every size
    rows = compacted(found.join(live, "anchor", "left_semi"), "live-segments")
    kinds = compacted(rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "start", "stop")).alias("at"), F.max("inner").alias("inner")), "kinds")
    length = F.col("at.stop") - F.col("at.start")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.max("inner").alias("inner"), F.sum(length).alias("bytes"), F.sum(length - (size - 1)).alias("windows"))
    several = compacted(several.where("d > 1 OR inner").drop("inner"), "several")
    full = HOT * 2 * size  # bytes: a segment around one place has twice ``size`` at most
    contested = kinds.join(several, "anchor").select(
        "anchor", "digest", "at.*",
        F.when(F.col("bytes") > full, F.pmod(F.xxhash64("digest"), F.ceil(F.col("bytes") / full))).otherwise(0).alias("salt"),
        F.when(F.col("bytes") > full, F.ceil(F.col("windows") / BUCKET_WINDOWS)).otherwise(0).cast("int").alias("buckets"),
    )
    contested = compacted(contested, "contested")
    total = contested.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // SHARD_BYTES))
    # a hot anchor's parts have shards of their own, other anchors share theirs
    shard = F.when(F.col("buckets") > 0, F.xxhash64("anchor", "salt")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    wanted = contested.withColumn("shard", shard).groupBy("text_key").agg(F.collect_list(F.struct("anchor", "digest", "shard", "buckets", "start", "stop")).alias("wanted"))
    wanted = compacted(wanted, "wanted-segments")
    # of equal texts one is cut, so a shard gets a segment once, whatever the number of copies
    texts = docs.join(few(wanted.select("text_key"), 20), "text_key", "left_semi").dropDuplicates(["text_key"])
    parts = _cut(texts.join(wanted, "text_key"))
    with small_batches(docs.sparkSession):
        verdicts = compacted(parts.groupBy("shard").applyInArrow(lambda t: judge_shard(t, size), _VERDICT), "verdicts")
    hot = verdicts.where("bucket is not null").groupBy("anchor", "bucket").applyInArrow(lambda t: meet_bucket(t, size), _VERDICT)
    partly = verdicts.where("runs is not null").unionByName(hot).groupBy("anchor", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    whole = kinds.where("n > 1").select("anchor", "digest", F.lit(None).cast("array<int>").alias("runs"))
    partly = partly.join(whole.select("anchor", "digest"), ["anchor", "digest"], "left_anti")
    judged = whole.unionByName(partly)
    return rows.join(judged, ["anchor", "digest"]).select("text_key", "start", "stop", "runs")


def _covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Merged byte ranges that the repeated windows cover."""
    edges = []
    for s in spans:
        if s["runs"] is None:
            edges.append((s["start"], s["stop"]))
        else:
            r = s["runs"]
            edges += [(s["start"] + a, s["start"] + b - 1 + size) for a, b in zip(r[::2], r[1::2])]
    out: list[list[int]] = []
    for a, b in sorted(edges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, size: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), F.unhex(F.sha1(t.cast("binary"))).alias("text_key"))
    spans = repeated_spans(docs.select("text_key", "text"), size)
    per_text = compacted(spans.distinct().groupBy("text_key").agg(F.collect_list(F.struct("start", "stop", "runs")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", batch_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
        for batch in batches:
            out = []
            for i, t, s in zip(*(c.to_pylist() for c in batch.columns)):
                data = t.encode()
                cut = _covered(s, size)
                ends = [0, *(x for r in cut for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((i, len(data), len(data) - len(kept), len(cut), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    batch_type = pa.int64()
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = per_text.select(F.col("text_key").alias("_key"), F.lit(True).alias("_hit"))
    marked = docs.join(few(keys, 20), docs["text_key"] == F.col("_key"), "left").drop("_key")
    same = marked.where("_hit is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    cut = marked.where("_hit").join(per_text, "text_key").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return same.unionByName(cut)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
