"""Which requests stream, and how a response goes back to the client."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.constants import LABEL_MARK
from maskweave.functions.labels import unredact
from maskweave.functions.text import endpoint, strip_leading_blank
from maskweave.operators.fragments import wants_stream
from maskweave.operators.sse import rebuilt_streams


def messages_request(method: Column, path: Column) -> Column:
    return endpoint(path).isin("/v1/messages", "/messages") & (method == "POST")


def stream_eligible(method: Column, path: Column, body: Column) -> Column:
    """Whether a response is streamed through: a chat or messages request that asks for it."""
    return (F.contains(path, F.lit("/chat/completions")) | messages_request(method, path)) & wants_stream(body)


def is_event_stream(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/event-stream"))


def needs_restoring(body: Column, n_labels: Column) -> Column:
    """Whether anything was redacted, or the body holds what looks like a label."""
    return (n_labels > 0) | F.contains(body, F.lit(LABEL_MARK))


def restored(responses: DataFrame, key: list[str]) -> DataFrame:
    """(key, body) of ``responses`` (key, status, content_type, body, pairs: map of label to original).

    Event streams are rebuilt if anything was redacted, else pass as they are, as
    do streams that failed; other bodies are restored as one text, without the
    blanks that some servers put in front."""
    stream = is_event_stream(F.col("content_type"))
    rebuilt = stream & F.col("status").between(200, 299) & needs_restoring(F.col("body"), F.size("pairs"))
    as_pairs = F.transform(F.map_entries("pairs"), lambda e: F.struct(e["value"].alias("original"), e["key"].alias("label")))
    plain = responses.where(~stream).select(*key, unredact(strip_leading_blank(F.col("body")), as_pairs).alias("body"))
    through = responses.where(stream & ~rebuilt).select(*key, "body")
    return plain.unionByName(through).unionByName(rebuilt_streams(responses.where(rebuilt), key))
