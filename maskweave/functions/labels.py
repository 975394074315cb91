"""Labels that stand for redacted text, and replacement that never reaches into them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.constants import LABEL_MARK, LABEL_PATTERN
from maskweave.functions.core import fold, let
from maskweave.functions.text import quoted, replace_ignoring_case

_LITERAL = "<<REDACTED_LITERAL_"


def label(kind: str, n: Column) -> Column:
    return F.concat(F.lit(f"{LABEL_MARK}{kind}_"), n.cast("string"), F.lit(">>"))


def escape_labels(text: Column) -> Column:
    """Text in which what looks like a label no longer does; ``unescape_labels`` restores it."""
    return F.replace(text, F.lit(LABEL_MARK), F.lit(_LITERAL))


def unescape_labels(text: Column) -> Column:
    return F.replace(text, F.lit(_LITERAL), F.lit(LABEL_MARK))


def between_labels(text: Column, change) -> Column:
    """``change`` on the parts of a text that are not labels."""

    def split(t: Column) -> Column:
        gaps = F.transform(F.split(t, LABEL_PATTERN, -1), change)
        labels = F.regexp_extract_all(t, F.lit(LABEL_PATTERN), F.lit(0))
        return F.array_join(F.flatten(F.zip_with(gaps, labels, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit(LABEL_MARK)), split(t)).otherwise(change(t)))


def _pieces(text: Column) -> Column:
    """A text cut at its labels: what lies between them at even places, labels at odd ones."""

    def cut(t: Column) -> Column:
        labels = F.regexp_extract_all(t, F.lit(LABEL_PATTERN), F.lit(0))
        both = F.zip_with(F.split(t, LABEL_PATTERN, -1), labels, lambda g, x: F.array(g, x))
        return F.filter(F.flatten(both), lambda x: x.isNotNull())

    return F.when(F.contains(text, F.lit(LABEL_MARK)), cut(text)).otherwise(F.array(text))


def _split_pieces(pieces: Column, holds, pattern: Column, mark: Column) -> Column:
    """``mark`` as a piece of its own in place of each match in what lies between labels."""

    def parts(x: Column) -> Column:
        return F.flatten(F.transform(F.split(x, pattern, -1), lambda g, j: F.when(j == 0, F.array(g)).otherwise(F.array(mark, g))))

    return F.flatten(F.transform(pieces, lambda x, i: F.when((i % 2 == 0) & holds(x), parts(x)).otherwise(F.array(x))))


def replace_literals(text: Column, pairs: Column, protect: bool = True) -> Column:
    """Replace each (original, label) of an ordered array, one after another.

    With ``protect`` labels stay whole; without it later originals may match inside them."""
    if not protect:
        return fold(pairs, text, lambda t, p: F.replace(t, p["original"], p["label"]))

    def step(pieces: Column, p: Column) -> Column:
        return _split_pieces(pieces, lambda x: (p["original"] != "") & F.contains(x, p["original"]), quoted(p["original"]), p["label"])

    return F.when(text.isNotNull(), F.array_join(fold(pairs, _pieces(text), step), ""))


def replace_keywords(text: Column, pairs: Column, protect: bool = True) -> Column:
    """The same for keywords (original, label, ci) that may ignore case."""
    if not protect:
        return fold(pairs, text, lambda t, p: F.when(p["ci"], replace_ignoring_case(t, p["original"], p["label"])).otherwise(F.replace(t, p["original"], p["label"])))

    def step(pieces: Column, p: Column) -> Column:
        pattern = F.when(p["ci"], F.concat(F.lit("(?iu)"), quoted(p["original"]))).otherwise(quoted(p["original"]))
        return _split_pieces(pieces, lambda x: (p["original"] != "") & (p["ci"] | F.contains(x, p["original"])), pattern, p["label"])

    return F.when(text.isNotNull(), F.array_join(fold(pairs, _pieces(text), step), ""))


def unredact(text: Column, pairs: Column) -> Column:
    """Restore the originals of (original, label) pairs, if the text holds any label."""
    restored = fold(pairs, text, lambda t, p: F.replace(t, p["label"], p["original"]))
    return F.when(F.contains(text, F.lit(LABEL_MARK)), restored).otherwise(text)


def longest_first(strings: Column) -> Column:
    """By length, longest first; equal lengths in text order."""
    return F.array_sort(strings, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
