"""Redaction of the fragments of sessions, with labels that stay the same within a session.

A session's labels count up in order of first appearance, for each class. The
matches of a fragment depend on that fragment alone, so the numbers are ranks of
first appearances and no fragment has to wait for another. They are ranked in two
levels (``ranks``), so a session may hold most of all originals:

1. equal texts of a session are redacted once, as the first of them (``first_seq``);
2. spans of personal data are found in the raw text and numbered by (first
   fragment, start from the right);
3. patterns are matched between the labels of the result, and numbered by (first
   fragment, longer first, text);
4. keywords have fixed numbers;
5. originals that the session knew by then and that still stand in the text are
   replaced too (forward propagation).

Distinct originals of a session are aggregated before they are numbered, and the
fold over a fragment reads only the originals that occur in it.

Between the steps a text goes by its session and its SHA-256 (``_id``). Texts are
stored once, in buckets by that key, and never moved again but past the automata:
what is found in them is small and is brought to them, and bodies are worked out
anew from it wherever they are read.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.constants import DEFAULT_THRESHOLD, LABEL_PATTERN
from maskweave.functions import spans as S
from maskweave.functions.labels import label, replace_keywords, replace_literals, unredact
from maskweave.operators import ranks, stateless
from maskweave.operators.report import timed
from maskweave.storage import beside, bucketed, compacted, few, stage

#: Words of an automaton, automata that a task builds one after another, and bytes of a session's texts that go past them there.
ORIGINALS, AUTOMATA, SLICE_BYTES = 100_000, 8, 64 << 20
#: A text of a session.
_KEY = ["session", "_id"]
_PAIRS = "array<struct<original:string,label:string>>"


def session_epochs(requests: DataFrame, profile: str, seq: str, config: str) -> DataFrame:
    """``requests`` with ``epoch``: it counts up whenever a profile's configuration changes."""
    rows = ranks.previous(ranks.dealt(requests, [profile], [seq]), [profile], [seq], config, "_before")
    changed = F.col("_before").isNotNull() & ~F.col("_before")[config].eqNullSafe(F.col(config))
    return ranks.running(rows, [profile], [seq], changed.cast("long"), "epoch").drop("_before", ranks.RANGE)


def first_texts(fragments: DataFrame) -> DataFrame:
    """(session, text, first_seq): each text of a session once, as it first came."""
    return fragments.groupBy("session", "text").agg(F.min("seq").alias("first_seq"))


def numbered(found: DataFrame, kind: str, *order: Column) -> DataFrame:
    """(session, original, first_seq, label) from (session, original, first_seq, rank columns).

    ``order`` ranks originals within the fragment where they first appear."""
    first = found.groupBy("session", "original").agg(F.min(F.struct("first_seq", *order)).alias("first"))
    rows = ranks.numbered(first, ["session"], ["first", "original"], "n")
    return rows.select("session", "original", F.col("first.first_seq").alias("first_seq"), label(kind, F.col("n")).alias("label"), "n")


def pii_dictionary(texts: DataFrame) -> DataFrame:
    """Labels of the spans in ``texts`` (session, first_seq, spans): the rightmost new one has the least number."""
    found = texts.select("session", "first_seq", F.explode("spans").alias("s"))
    found = found.select("session", "first_seq", F.col("s.text").alias("original"), (-F.col("s.start")).alias("at"))
    return numbered(found, "PII", F.col("at"))


def regex_dictionary(texts: DataFrame) -> DataFrame:
    """Labels of the matches in ``texts`` (session, first_seq, matches)."""
    found = texts.select("session", "first_seq", F.explode("matches").alias("original"))
    return numbered(found, "REGEX", (-F.length("original")).alias("len"), F.col("original").alias("o"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _distinct(fragments: DataFrame) -> DataFrame:
    """(session, _id, text, first_seq, n_bytes): ``first_texts`` by the texts' digests."""
    rows = fragments.withColumn("_id", _digest("text")).groupBy(*_KEY).agg(F.first("text").alias("text"), F.min("seq").alias("first_seq"))
    return rows.withColumn("n_bytes", F.octet_length("text"))


def _with_pairs(texts: DataFrame, wanted: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """``texts`` with ``name``: the (original, label) pairs of their originals in ``wanted`` (session, _id, original)."""
    got = wanted.distinct().join(dictionary.select("session", "original", "label"), ["session", "original"]).groupBy(*_KEY).agg(F.collect_list(F.struct("original", "label")).alias(name))
    got = compacted(got, "session-" + name)
    return texts.join(beside(got), _KEY, "left").withColumn(name, F.coalesce(name, F.array().cast(_PAIRS)))


def longest_pairs(pairs: Column) -> Column:
    return F.array_sort(pairs, lambda a, b: F.when(F.length(a["original"]) != F.length(b["original"]), F.length(b["original"]) - F.length(a["original"])).when(a["original"] < b["original"], -1).when(a["original"] > b["original"], 1).otherwise(0))


def known_originals(texts: DataFrame, dictionary: DataFrame, body: str, by: str = "text", n_bytes: DataFrame | None = None) -> DataFrame:
    """(session, text, known): originals of the session that first appeared no later and occur in ``body``.
    Texts go by the column ``by``. ``n_bytes``: about how many bytes (session, b) each session's bodies have.

    A session's originals become automata of at most ``ORIGINALS`` words, and its texts go past them in
    slices of about ``SLICE_BYTES``, so neither pairs of texts and originals nor a whole session stand
    anywhere. A task builds up to ``AUTOMATA`` of them in turn, so texts are sent once for that many."""
    n_words = dictionary.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    if n_bytes is None:
        n_bytes = texts.groupBy("session").agg(F.sum(F.octet_length(body)).alias("b"))
    parts = n_words.join(n_bytes, "session").select("session", F.ceil(F.col("n") / (ORIGINALS * AUTOMATA)).cast("int").alias("chunks"), F.greatest(F.ceil(F.col("b") / SLICE_BYTES), F.lit(1)).cast("int").alias("slices"))
    parts = compacted(parts, "session-parts")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # no filter on the body: it would be worked out twice
    held = texts.join(few(parts), "session").select("session", F.pmod(F.xxhash64(by), "slices").cast("int").alias("slice"), each("chunks").alias("chunk"), F.col(by).alias("_by"), F.coalesce(F.col(body), F.lit("")).alias("_body"), F.col("first_seq").alias("_seq"))
    words = dictionary.join(few(parts), "session").where("original <> ''").select("session", each("slices").alias("slice"), F.pmod(F.xxhash64("original"), "chunks").cast("int").alias("chunk"), "original", "label", F.col("first_seq").alias("_seen"))
    key = ["session", "slice", "chunk"]
    of = {f.name: f.dataType.simpleString() for f in texts.schema}
    n = ORIGINALS
    found = held.groupBy(*key).cogroup(words.groupBy(*key)).applyInArrow(lambda texts, words: _occurring(texts, words, n), f"session {of['session']}, _by {of[by]}, known {_PAIRS}")
    return found.groupBy("session", F.col("_by").alias(by)).agg(F.flatten(F.collect_list("known")).alias("known"))


def _occurring(texts: pa.Table, words: pa.Table, most: int) -> pa.Table:
    """Texts of a slice with the words that they hold, by automata of ``most`` words."""
    import ahocorasick

    out: dict[int, list[dict]] = {}
    for start in range(0, len(words), most):
        part = words[start : start + most]
        originals, labels, seen = (part[c].to_pylist() for c in ("original", "label", "_seen"))
        at: dict[str, list[int]] = {}
        for i, word in enumerate(originals):
            at.setdefault(word, []).append(i)
        automaton = ahocorasick.Automaton()
        for word, places in at.items():
            automaton.add_word(word, places)
        automaton.make_automaton()
        for row, (body, seq) in enumerate(zip(texts["_body"], texts["_seq"])):
            found, first = {i for _, places in automaton.iter(body.as_py()) for i in places}, seq.as_py()
            known = [{"original": originals[i], "label": labels[i]} for i in sorted(found) if seen[i] <= first]
            if known:
                out.setdefault(row, []).extend(known)
    rows = texts.take(pa.array(list(out), pa.int64()))
    kind = pa.list_(pa.struct([("original", pa.string()), ("label", pa.string())]))
    return pa.table({"session": rows["session"], "_by": rows["_by"], "known": pa.array(list(out.values()), kind)})


def _patterned(fragments: DataFrame, spans: Column | None, patterns: list[str] | None, timings: dict[str, float] | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each text once (session, _id, first_seq, n_bytes, body) with its spans replaced, its matches (session, _id, first_seq,
    matches), stored, and the labels of matches and of both."""
    texts = _distinct(fragments)
    found = lambda body: stateless.matches(F.col(body), patterns or []).alias("matches")
    # each text is searched once: later steps read what was found
    with timed("spans", timings):
        if spans is None:
            pii = None
        else:
            texts = bucketed(texts.withColumn("spans", spans), _KEY, "session-texts")
            pii = pii_dictionary(texts)
            texts = _with_pairs(texts, texts.select(*_KEY, F.explode("spans.text").alias("original")), pii, "pii")
            of = lambda s: F.element_at(F.filter("pii", lambda p: p["original"] == s["text"]), 1)["label"]
            texts = texts.withColumn("body", F.when(F.size("spans") > 0, S.splice(F.col("text"), F.col("spans"), of)).otherwise(F.col("text")))
    with timed("patterns", timings):
        if spans is None:
            matched = bucketed(texts.withColumn("matches", found("text")), _KEY, "session-texts")
            texts = matched.withColumn("body", F.col("text"))
        else:
            matched = stage(texts.select(*_KEY, "first_seq", found("body")), "session-matches")
        regex = regex_dictionary(matched)
    columns = ["session", "original", "label", "first_seq"]
    labels = [d.select("session", F.lit(kind).alias("kind"), *columns[1:]) for d, kind in ((pii, "PII"), (regex, "REGEX")) if d is not None]
    return texts.select(*_KEY, "first_seq", "n_bytes", "body"), matched, regex, labels[0] if len(labels) == 1 else labels[0].unionByName(labels[1])


def _with_keywords(fragments: DataFrame, dictionary: DataFrame, keyed: Column | None) -> DataFrame:
    """``dictionary`` with the keywords of every session."""
    if keyed is None:
        return dictionary
    words = fragments.select("session").distinct().select("session", F.explode(keyed).alias("k"))
    return dictionary.unionByName(words.select("session", F.lit("KEYWORD").alias("kind"), F.col("k.original").alias("original"), F.col("k.label").alias("label"), F.lit(None).cast(dictionary.schema["first_seq"].dataType).alias("first_seq")))


def session_labels(fragments: DataFrame, spans: Column | None = None, patterns: list[str] | None = None, keywords: list[tuple[str, bool]] | None = None) -> DataFrame:
    """The dictionary that ``redact_sessions`` returns, without the texts: labels don't depend on the steps after patterns."""
    dictionary = _patterned(fragments, spans, patterns, None)[-1]
    return _with_keywords(fragments, dictionary, stateless.keyword_pairs(keywords) if keywords else None)


def redact_sessions(fragments: DataFrame, spans: Column | None = None, patterns: list[str] | None = None, keywords: list[tuple[str, bool]] | None = None, timings: dict[str, float] | None = None, digest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Redact ``fragments`` (session, seq, text). ``spans``: personal data in ``text``. ``timings`` gets the seconds of each stage.

    Returns the fragments with ``redacted_text``, and with the SHA-256 of their texts if ``digest`` names a column for it,
    and the dictionary (session, kind, original, label)."""
    texts, matched, regex, dictionary = _patterned(fragments, spans, patterns, timings)
    with timed("keywords", timings):
        n_bytes = matched if "n_bytes" in matched.columns else texts
        texts = _with_pairs(texts, matched.select(*_KEY, F.explode("matches").alias("original")), regex, "regex")
        texts = texts.withColumn("body", F.when(F.size("regex") > 0, replace_literals(F.col("body"), longest_pairs(F.col("regex")))).otherwise(F.col("body")))
        keyed = stateless.keyword_pairs(keywords) if keywords else None
        if keyed is not None:
            texts = texts.withColumn("body", replace_keywords(F.col("body"), keyed))
    with timed("forward propagation", timings):
        dictionary = stage(dictionary, "session-labels")
        n_bytes = n_bytes.groupBy("session").agg(F.sum("n_bytes").alias("b"))
        known = compacted(known_originals(texts, dictionary, "body", "_id", n_bytes), "session-known")
    texts = texts.join(beside(known), _KEY, "left")
    body = F.when(F.col("known").isNotNull(), replace_literals(F.col("body"), longest_pairs(F.col("known")))).otherwise(F.col("body"))
    out = fragments.withColumn("_id", _digest("text")).join(texts.select(*_KEY, body.alias("redacted_text")), _KEY)
    return out.withColumnRenamed("_id", digest) if digest else out.drop("_id"), _with_keywords(fragments, dictionary, keyed)


def redact_for_profile(fragments: DataFrame, profile: dict, timings: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``redact_sessions`` by a profile's switches; a stage that is off is not in the plan."""
    from maskweave.operators import rules

    types = tuple(profile.get("enabled_pii_types") or ()) if profile.get("use_openai_model", True) else ()
    spans = rules.detect(F.col("text"), types, profile.get("pii_confidence_threshold", DEFAULT_THRESHOLD)) if types else None
    patterns = stateless.usable_patterns(fragments.sparkSession, [stateless.Pattern(p["pattern"], p.get("enabled", True)) for p in profile.get("regex_patterns") or ()])
    keywords = stateless.usable_keywords([stateless.Keyword(k["text"], k.get("case_sensitive", True), k.get("enabled", True)) for k in profile.get("keywords") or ()])
    return redact_sessions(fragments, spans, patterns, keywords, timings)


def profile_totals(redacted: DataFrame, n_keywords: int) -> DataFrame:
    """Requests and labels of each session: distinct ones by request, summed; every keyword counts in every request."""
    held = held_labels(redacted, ["session", "seq"])
    n = held.groupBy("session").agg(F.count(F.lit(1)).alias("n_requests"))
    per = _counts(held, ["session", "seq"]).where("kind <> 'KEYWORD'").groupBy("session").pivot("kind", ["PII", "REGEX"]).agg(F.sum("n_labels"))
    zero = F.lit(0).cast("long")
    return n.join(per, "session", "left").select("session", "n_requests", F.coalesce("PII", zero).alias("n_pii"), F.coalesce("REGEX", zero).alias("n_regex"), (F.col("n_requests") * n_keywords).alias("n_keyword"))


def profile_counts(redacted: DataFrame) -> DataFrame:
    """(session, n_requests, n_labels): requests of each session, and distinct labels by request and class, summed."""
    held = held_labels(redacted, ["session", "seq"])
    n = held.groupBy("session").agg(F.count(F.lit(1)).alias("n_requests"))
    per = _counts(held, ["session", "seq"]).groupBy("session").agg(F.sum("n_labels").alias("n_labels"))
    return n.join(per, "session", "left").select("session", "n_requests", F.coalesce("n_labels", F.lit(0).cast("long")).alias("n_labels"))


def restore_sessions(redacted: DataFrame, dictionary: DataFrame, body: str = "redacted_text", by: str | None = None) -> DataFrame:
    """``redacted`` with ``restored_text``: the labels in each text are looked up by a hash join, not tried one by one.

    With ``by``, a column by which a session's texts go, texts that are stored in buckets by it are read twice and not moved;
    without it rows are numbered as they are stored, and texts with labels go to theirs."""
    if by is None:
        redacted = stage(redacted.withColumns({"_row": F.monotonically_increasing_id(), "_labels": _labels(body)}), "session-redacted")
        some = F.coalesce(F.size("_labels"), F.lit(0)) > 0
        out = _restored(redacted.where(some), redacted.select("session", "_row", F.explode("_labels").alias("label")), dictionary, body, "_row")
        return out.unionByName(redacted.where(~some).withColumn("restored_text", F.col(body))).drop("_row", "_labels")
    return _restored(redacted, redacted.select("session", by, F.explode(_labels(body)).alias("label")).distinct(), dictionary, body, by)


def _restored(redacted: DataFrame, held: DataFrame, dictionary: DataFrame, body: str, by: str) -> DataFrame:
    """``redacted`` with ``restored_text``; ``held`` (session, by, label): the labels in its texts."""
    pairs = held.join(dictionary.select("session", "label", "original").distinct(), ["session", "label"]).groupBy("session", by).agg(F.collect_list(F.struct("original", "label")).alias("_pairs"))
    pairs = compacted(pairs, "session-pairs")
    return redacted.join(beside(pairs), ["session", by], "left").withColumn("restored_text", F.when(F.col("_pairs").isNotNull(), unredact(F.col(body), F.col("_pairs"))).otherwise(F.col(body))).drop("_pairs")


def _labels(body: str) -> Column:
    """The distinct labels of a text."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(LABEL_PATTERN), F.lit(0)))


def held_labels(redacted: DataFrame, key: list[str], body: str = "redacted_text") -> DataFrame:
    """(key, labels) of each row, stored: what is counted from it doesn't redact again."""
    return stage(redacted.select(*key, _labels(body).alias("labels")), "session-held")


def request_counts(redacted: DataFrame, key: list[str], body: str = "redacted_text") -> DataFrame:
    """Distinct labels of each class for each key."""
    return _counts(redacted.select(*key, _labels(body).alias("labels")), key)


def _counts(held: DataFrame, key: list[str]) -> DataFrame:
    kind = F.regexp_extract("label", "_([A-Z]+)_", 1)
    return held.select(*key, F.explode("labels").alias("label")).groupBy(*key, kind.alias("kind")).agg(F.countDistinct("label").alias("n_labels"))
