"""Scalar functions on text, versions, paths and headers, as JVM-side expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.constants import CREDENTIAL_HEADERS, ENDPOINTS, PREVIEW_CHARS, REQUEST_HOP_HEADERS, RESPONSE_HOP_HEADERS, RTL_LANGUAGES, TRIMMED
from maskweave.functions.core import let


def trim_ws(s: Column) -> Column:
    return F.btrim(s, F.lit(TRIMMED))


def split_on(s: Column, delimiter: str) -> Column:
    """Pieces between delimiters; an empty last piece is left out, and an empty text has none."""
    pieces = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def quoted(literal: Column) -> Column:
    """A pattern that matches the literal and nothing else."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def safe_replacement(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\$])", r"\\$1")


def replace_ignoring_case(s: Column, needle: Column, label: Column) -> Column:
    """Literal replacement in any case; an empty needle changes nothing."""
    pattern = F.concat(F.lit("(?iu)"), quoted(needle))
    return F.when(needle == "", s).otherwise(F.regexp_replace(s, pattern, safe_replacement(label)))


def format_fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, as C's printf has it: ties by the exact binary value go to the even digit.
    Java's formatter rounds the shortest decimal form up. Spark's number formats print no more than 17 digits
    exactly, so whole numbers beyond them are printed as such."""
    x = x.cast("double")
    pattern = F.lit("0." + "0" * digits if digits else "0")
    number = F.call_function("format_number", x, pattern)
    long = F.concat(x.cast("bigint").cast("string"), F.lit("." + "0" * digits if digits else ""))
    return F.when(F.abs(x).between(2.0**53, 2.0**62), long).when(F.isnan(x) | (F.abs(x) > 2.0**62), F.format_string(f"%.{digits}f", x)).otherwise(number)


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    power = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1)
    return F.concat(format_fixed(n / F.pow(F.lit(1024.0), power), 1), F.lit(" "), unit)


def format_float(x: Column, digits: int = 1, comma: bool = False) -> Column:
    """A number with so many decimals, and a decimal comma where the language has one."""
    out = format_fixed(x, digits)
    return F.replace(out, F.lit("."), F.lit(",")) if comma else out


def parse_float(s: Column, comma: bool = False) -> Column:
    """The number that a text starts with, else 0. With ``comma`` points count as commas, and commas are decimal."""
    plain = F.replace(s, F.lit(","), F.lit(".")) if comma else s
    number = F.regexp_extract(plain, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(0.0))


def format_message(template: Column, *args: Column) -> Column:
    """``{0}``, ``{1}`` ... replaced in order, so later arguments reach into earlier ones as well."""
    for i, a in enumerate(args):
        template = F.replace(template, F.lit(f"{{{i}}}"), a)
    return template


def is_rtl(tag: Column) -> Column:
    return F.split_part(tag, F.lit("-"), F.lit(1)).isin(*RTL_LANGUAGES)


def language_matches(a: Column, b: Column) -> Column:
    dash = F.lit("-")
    return (a == b) | F.startswith(a, F.concat(b, dash)) | F.startswith(b, F.concat(a, dash))


def endpoint(path: Column) -> Column:
    """The known suffix of a path without its query, or the whole path in lower case."""
    low = F.lower(F.split_part(path, F.lit("?"), F.lit(1)))
    out = low
    for suffix in reversed(ENDPOINTS):
        out = F.when(F.endswith(low, F.lit(suffix)), suffix).otherwise(out)
    return out


def joined_path(base: Column, path: Column) -> Column:
    """An upstream path and a request path without what they share: the longest end of one that starts the other."""
    bare = F.when(F.endswith(base, F.lit("/")), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)

    def join(b: Column) -> Column:
        most = F.least(F.length(b), F.length(path))
        sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        shared = F.coalesce(F.array_max(F.filter(sizes, lambda i: F.right(b, i) == F.left(path, i))), F.lit(0))
        kept = F.left(b, F.length(b) - shared)
        doubled = F.endswith(kept, F.lit("/")) & F.startswith(path, F.lit("/"))
        return F.concat(F.when(doubled, F.left(kept, F.length(kept) - 1)).otherwise(kept), path)

    return F.when(path == "", bare).otherwise(let(bare, join))


def version_parts(v: Column) -> Column:
    """Up to three numbers of a version without its suffix, missing ones 0; null if not a version."""
    core = F.regexp_extract(v, r"^([^-+]*)", 1)
    parts = F.slice(F.split(core, r"\.", -1), 1, 3)
    numbers = F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1))
    good = ~F.exists(numbers, lambda p: p == "")
    padded = F.slice(F.concat(F.transform(numbers, lambda p: p.cast("int")), F.array(F.lit(0), F.lit(0))), 1, 3)
    return F.when(good, padded)


def is_newer(remote: Column, local: Column) -> Column:
    """Whether a version is newer; false if either is none."""
    return F.coalesce(version_parts(remote) > version_parts(local), F.lit(False))


def preview(body: Column, most: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("...[truncated]"))).otherwise(body)


def request_summary(method: Column, path: Column, pii: Column, regex: Column, keywords: Column) -> Column:
    counted = [F.when(n > 0, F.concat(F.lit(f"{name} "), n.cast("string"))) for name, n in (("PII", pii), ("Regex", regex), ("Keywords", keywords))]
    return F.concat_ws(" | ", F.concat(method, F.lit(" "), path), *counted)


def kept_headers(headers: Column, response: bool = False) -> Column:
    hops = RESPONSE_HOP_HEADERS if response else REQUEST_HOP_HEADERS
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*hops))


def with_credentials(headers: Column, key: Column) -> Column:
    """Headers that go upstream: client credentials give way to the real key in the client's own style; without any, a bearer key is added."""

    def value(k: Column, v: Column) -> Column:
        scheme = F.when((F.lower(k) == "authorization") & F.contains(v, F.lit(" ")), F.concat(F.split_part(v, F.lit(" "), F.lit(1)), F.lit(" "), key))
        return F.when(F.lower(k).isin(*CREDENTIAL_HEADERS), F.coalesce(scheme, key)).otherwise(v)

    out = F.transform_values(kept_headers(headers), value)
    has = F.exists(F.map_keys(out), lambda k: F.lower(k).isin(*CREDENTIAL_HEADERS))
    return F.when(has, out).otherwise(F.map_concat(out, F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), key))))


def range_bounds(offset: Column, length: Column, suffix: Column, size: Column) -> Column:
    """First and last byte of a byte range: of the last ``suffix`` bytes, or from an offset."""
    start = F.when(suffix.isNotNull(), F.greatest(F.lit(0), size - suffix)).otherwise(offset)
    count = F.least(F.coalesce(length, size - offset), size - offset)
    end = F.when(suffix.isNotNull(), size - 1).otherwise(offset + count - 1)
    return F.struct(start.cast("long").alias("first"), end.cast("long").alias("last"))


def route_pattern(pattern: str) -> tuple[str, list[str]]:
    """A route such as ``/updates/:channel/:file?`` as an anchored regular expression and its names."""
    out, names = "^", []
    for segment in filter(None, pattern.split("/")):
        optional, name = segment.endswith("?"), segment.rstrip("?")
        piece = r"([^/]+)" if name.startswith(":") else rf"(?:\Q{name}\E)"
        if name.startswith(":"):
            names.append(name[1:])
        out += rf"(?:/+{piece})?" if optional else rf"/+{piece}"
    return out + "/*$", names


def route_params(path: Column, pattern: str) -> Column:
    """A map of a route's parameters; null if the path doesn't fit."""
    regex, names = route_pattern(pattern)
    entries = [x for i, n in enumerate(names) for x in (F.lit(n), F.nullif(F.regexp_extract(path, regex, i + 1), F.lit("")))]
    found = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(path.rlike(regex), found)


def strip_leading_blank(body: Column) -> Column:
    return F.ltrim(body, F.lit(" \t\r\n"))


def placeholder(kind: Column) -> Column:
    """``[REDACTED PRIVATE EMAIL]`` for private_email."""
    return F.concat(F.lit("[REDACTED "), F.replace(F.upper(kind), F.lit("_"), F.lit(" ")), F.lit("]"))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def millis_of(ts: Column) -> Column:
    return F.unix_millis(ts)


def new_id() -> Column:
    """A fresh random id for each row."""
    return F.uuid()
