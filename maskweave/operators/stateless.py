"""Redaction of each text on its own, with patterns and keywords."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import TRIMMED
from maskweave.functions.core import let
from maskweave.functions.labels import between_labels, label, longest_first, replace_keywords, replace_literals


@dataclass(frozen=True)
class Keyword:
    text: str
    case_sensitive: bool = True
    enabled: bool = True


@dataclass(frozen=True)
class Pattern:
    pattern: str
    enabled: bool = True


def usable_patterns(spark: SparkSession, patterns: list[Pattern]) -> list[str]:
    """Enabled patterns that are not blank and compile; others are skipped, as Spark would fail on them."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    out = []
    for p in patterns:
        if p.enabled and p.pattern.strip(TRIMMED):
            try:
                compile_("(?iu)" + p.pattern)
                out.append(p.pattern)
            except IllegalArgumentException:  # a pattern that doesn't compile
                continue
    return out


def usable_keywords(keywords: list[Keyword]) -> list[tuple[str, bool]]:
    """(text, ignores case) of enabled keywords, trimmed, longest first and then as configured.

    One text has one label; it ignores case if any of its entries does."""
    by: dict[str, bool] = {}
    for k in keywords:
        text = k.text.strip(TRIMMED)
        if k.enabled and text:
            by[text] = by.get(text, False) or not k.case_sensitive
    return sorted(by.items(), key=lambda x: -len(x[0]))


def matches(text: Column, patterns: list[str], protect: bool = True) -> Column:
    """The distinct non-empty matches of all patterns, in any case, longest first."""
    if not patterns:
        return F.array().cast("array<string>")

    def of(t: Column) -> Column:
        return F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?iu)" + p), F.lit(0)) for p in patterns]))

    found = of(text)
    if protect:  # labels don't match
        from maskweave.constants import LABEL_MARK, LABEL_PATTERN

        apart = F.flatten(F.transform(F.split(text, LABEL_PATTERN, -1), of))
        found = F.when(F.contains(text, F.lit(LABEL_MARK)), apart).otherwise(found)
    return longest_first(F.array_distinct(F.filter(found, lambda m: m != "")))


def redact_patterns(text: Column, patterns: list[str], start: int = 0, protect: bool = True) -> Column:
    """struct(text, pairs): every literal occurrence of each match replaced by its numbered label."""
    pairs = F.transform(matches(text, patterns, protect), lambda m, i: F.struct(m.alias("original"), label("REGEX", i + start).alias("label")))
    return let(pairs, lambda p: F.struct(F.when(F.size(p) > 0, replace_literals(text, p, protect)).otherwise(text).alias("text"), p.alias("pairs")))


def keyword_pairs(keywords: list[tuple[str, bool]], start: int = 0) -> Column:
    """(original, label, ci) of all keywords, whether or not they occur."""
    if not keywords:
        return F.array().cast("array<struct<original:string,label:string,ci:boolean>>")
    return F.array(*[F.struct(F.lit(t).alias("original"), F.lit(f"<<REDACTED_KEYWORD_{i + start}>>").alias("label"), F.lit(ci).alias("ci")) for i, (t, ci) in enumerate(keywords)])


def redact_keywords(text: Column, keywords: list[tuple[str, bool]], start: int = 0, protect: bool = True) -> Column:
    """Texts with keywords replaced, longest keyword first."""
    return replace_keywords(text, keyword_pairs(keywords, start), protect) if keywords else text


__all__ = ["Keyword", "Pattern", "between_labels", "keyword_pairs", "matches", "redact_keywords", "redact_patterns", "usable_keywords", "usable_patterns"]
