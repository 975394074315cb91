"""Spans of text (type, text, start, end, confidence): half-open, in code points."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions.core import fold, let
from maskweave.functions.text import placeholder

SPAN = "struct<type:string,text:string,start:int,end:int,confidence:float>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(kind: Column, text: Column, start: Column, confidence: Column | float) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(kind.alias("type"), text.alias("text"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), conf.cast("float").alias("confidence"))


def pattern_spans(text: Column, pattern: str, kind: str, confidence: float) -> Column:
    """All matches of a pattern with their places, without any Python: what lies
    between matches and the matches themselves give the running offset."""

    def place(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        begins = fold(
            F.slice(lengths, 1, F.size(found)),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        return let(begins, lambda b: F.transform(found, lambda m, i: span(F.lit(kind), m, F.get(b, i) + F.length(F.get(gaps, i)), confidence)))

    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(gaps, lambda g: let(found, lambda m: place(g, m)))
    return F.when(text.rlike(pattern), placed).otherwise(no_spans())


def in_order(spans: Column) -> Column:
    """By start, longer ones first."""
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))


def merge_overlaps(spans: Column) -> Column:
    """One span after another: the first kept span that a new one overlaps gives
    way if the new one is strictly longer, and the new one is dropped if not."""

    def step(kept: Column, s: Column) -> Column:
        meets = F.transform(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))
        return let(F.array_position(meets, True), lambda at: F.when(at == 0, F.concat(kept, F.array(s))).otherwise(
            F.transform(kept, lambda k, i: F.when((i + 1 == at) & (s["end"] - s["start"] > k["end"] - k["start"]), s).otherwise(k))))

    return fold(in_order(spans), no_spans(), step)


def confident(spans: Column, threshold: Column | float) -> Column:
    """Spans at or above the threshold, compared as 32-bit floats. Stands after the merge."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.filter(spans, lambda s: s["confidence"] >= limit.cast("float"))


def of_types(spans: Column, types: list[str]) -> Column:
    return F.filter(spans, lambda s: s["type"].isin(*types)) if types else no_spans()


def valid(spans: Column, length: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] < s["end"]) & (s["end"] <= length))


def from_the_right(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: b["start"] - a["start"])


def splice(text: Column, spans: Column, replacement) -> Column:
    """``replacement(span)`` in place of each span, from the right."""
    return fold(from_the_right(spans), text, lambda t, s: F.overlay(t, replacement(s), s["start"] + 1, s["end"] - s["start"]))


def redact_placeholders(text: Column, spans: Column, template: str | None = None) -> Column:
    """Irreversible redaction: ``[REDACTED TYPE]``, or a template as it is, in place of each span."""
    return splice(text, valid(spans, F.length(text)), lambda s: placeholder(s["type"]) if template is None else F.lit(template))


def describe(spans: Column) -> Column:
    """``type: text`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(": ", s["type"], s["text"]))


def summary(spans: Column) -> Column:
    """What was found, in words for none, one or several."""
    n = F.size(spans)
    return F.when(n == 0, "No sensitive data found").when(n == 1, "1 item redacted").otherwise(F.concat(n.cast("string"), F.lit(" items redacted")))
