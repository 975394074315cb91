"""A rule detector: kinds of personal data that patterns can tell, with confidences.

Names, addresses and free-form dates need a model; ``detect`` takes the spans of
any backend besides. Patterns avoid look-around and Unicode word edges, so they
mean the same to other engines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.constants import DEFAULT_THRESHOLD, PII_CATEGORIES, PII_TYPES
from maskweave.functions.spans import confident, merge_overlaps, of_types, pattern_spans, valid

#: (type, pattern, confidence)
RULES = (
    ("private_email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.99),
    ("private_url", r"(?:https?|ftp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0.95),
    ("account_number", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", 0.97),
    ("private_phone", r"\+?[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}", 0.92),
    ("private_date", r"[12][0-9]{3}-[01][0-9]-[0-3][0-9]", 0.90),
    ("secret", r"AKIA[A-Z0-9]{16,}", 0.99),
    ("secret", r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{6,}", 0.93),
    ("private_phone", r"[0-9]{3}-[0-9]{4}", 0.60),
)


def candidates(text: Column, types: tuple[str, ...] = PII_TYPES) -> Column:
    """All matches of the rules of these types."""
    found = [pattern_spans(text, p, kind, c) for kind, p, c in RULES if kind in types]
    return F.flatten(F.array(*found))


def detect(text: Column, types: tuple[str, ...] = PII_TYPES, threshold: Column | float = DEFAULT_THRESHOLD, more: Column | None = None) -> Column:
    """Spans of a text: candidates of the enabled types, merged, then held against the threshold.

    ``more``: spans of another backend, such as a model."""
    found = candidates(text, types)
    if more is not None:
        found = F.concat(found, more)
    return confident(merge_overlaps(valid(of_types(found, list(types)), F.length(text))), threshold)


def categories(spark) -> DataFrame:
    """(category, type): a table of eight rows."""
    return spark.createDataFrame([(c, t) for c, ts in PII_CATEGORIES.items() for t in ts], "category string, type string")
