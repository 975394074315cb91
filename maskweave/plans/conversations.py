"""Queries over conversations: as request bodies and as event streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.operators import fragments as P
from maskweave.operators import responses as R
from maskweave.operators import sse
from maskweave.storage import fresh_path


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat request for each conversation: even turns as strings, odd ones as parts with an image, all with a tool call."""
    t = _turns(spark, sf_dir)
    parts = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    mixed = F.to_json(F.struct("role", parts.alias("content"), F.array(F.struct(F.struct(F.lit("f").alias("name"), F.col("role").alias("arguments")).alias("function"))).alias("tool_calls")))
    message = F.when(F.col("turn") % 2 == 0, plain).otherwise(mixed)
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    return grouped.select("conv_id", F.concat(F.lit('{"model":"x","stream":true,"messages":['), F.array_join(F.transform("ms", lambda m: m["m"]), ","), F.lit("]}")).alias("body"))


def fragment_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.exploded(request_bodies(spark, sf_dir))
    return out.select("conv_id", "frag_seq", "text")


def fragment_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies put together with changed texts, and taken apart again."""
    parts = P.exploded(request_bodies(spark, sf_dir)).withColumn("text", F.concat(F.lit("x:"), "text"))
    return P.exploded(P.reassembled(parts, ["conv_id"])).select("conv_id", "frag_seq", "text")


def stream_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_bodies(spark, sf_dir).select("conv_id", P.wants_stream(F.col("body")).alias("stream"))


def chat_streams(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """(conv_id, turn, body): a stream for each turn, in pieces of nine characters and an end marker."""
    t = _turns(spark, sf_dir)
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / 9)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text), i * 9 + 1, F.lit(9)))
    event = lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))), F.lit("\r\n\r\n"))
    return t.select("conv_id", "turn", F.concat(F.array_join(F.transform(pieces, event), ""), F.lit("data: [DONE]\n\n")).alias("body"))


def _contents(streams: DataFrame) -> DataFrame:
    events = streams.select("conv_id", "turn", F.posexplode(sse.event_payloads(F.col("body"))).alias("event_idx", "payload"))
    return events.withColumn("content", sse.chat_content(F.col("payload")))


def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _contents(chat_streams(spark, sf_dir))
    return out.select("conv_id", "turn", F.col("event_idx").cast("long").alias("event_idx"), F.coalesce("content", "payload").alias("content"))


def _joined(contents: DataFrame) -> DataFrame:
    held = contents.where("content is not null").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("event_idx", "content"))).alias("cs"))
    return held.select("conv_id", "turn", F.array_join(F.transform("cs", lambda c: c["content"]), "").alias("content"))


def sse_channel_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_contents(chat_streams(spark, sf_dir)))


def sse_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' texts over pieces of 5, 0, 11 and 2; joined they are the text again."""
    t = _turns(spark, sf_dir).withColumn("p", sse.redistributed(F.col("text"), F.array(*[F.lit(n).cast("long") for n in (5, 0, 11, 2)])))
    return t.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.array_join("p", "").alias("joined"), F.length(F.get("p", F.lit(0))).cast("long").alias("n_first"))


def sse_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose labels are split over events, restored."""
    t = _turns(spark, sf_dir)
    first = F.split_part("text", F.lit(" "), F.lit(1))
    label = "<<REDACTED_KEYWORD_0>>"
    path = fresh_path(spark, "turns")
    marked = t.select("conv_id", "turn", F.when(F.length(first) > 2, F.replace("text", first, F.lit(label))).otherwise(F.col("text")).alias("text"), first.alias("first"))
    marked.write.parquet(f"{path}/conversations.parquet")
    held = spark.read.parquet(f"{path}/conversations.parquet")
    pairs = F.create_map(F.lit(label), F.col("first"))
    streams = chat_streams(spark, path).join(held.select("conv_id", "turn", pairs.alias("pairs")), ["conv_id", "turn"])
    return _joined(_contents(sse.rebuilt_streams(streams, ["conv_id", "turn"])))


def fragment_whole_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without messages are one fragment each."""
    t = _turns(spark, sf_dir)
    bodies = t.select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("input"), F.col("turn").alias("n"))).alias("body"))
    return P.exploded(bodies).select("conv_id", "turn", "frag_seq", "text")


#: Where the events of each kind of stream hold their text.
CHANNELS = {
    "reasoning": "$.choices[0].delta.reasoning",
    "details": "$.choices[0].delta.reasoning_details[0].text",
    "tool": "$.choices[0].delta.tool_calls[0].function.arguments",
    "block text": "$.delta.text",
    "block json": "$.delta.partial_json",
    "response delta": "$.delta",
    "response text": "$.response.output[0].content[0].text",
}


def _channel_event(piece: Column, kind: Column) -> Column:
    """An event with a piece of text in the channel of that number."""
    choice = lambda delta: F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"))
    block = lambda inner, name: F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit(inner).alias("type"), piece.alias(name)).alias("delta"))
    call = F.struct(F.lit(0).alias("index"), F.struct(piece.alias("arguments")).alias("function"))
    content = F.array(F.struct(piece.alias("text")))
    events = (
        choice(F.struct(piece.alias("reasoning"))),
        choice(F.struct(F.array(F.struct(piece.alias("text"))).alias("reasoning_details"))),
        choice(F.struct(F.array(call).alias("tool_calls"))),
        block("text_delta", "text"),
        block("input_json_delta", "partial_json"),
        F.struct(F.lit("response.output_text.delta").alias("type"), F.lit("i").alias("item_id"), F.lit(0).alias("output_index"), piece.alias("delta")),
        F.struct(F.lit("response.completed").alias("type"), F.struct(F.array(F.struct(content.alias("content"))).alias("output")).alias("response")),
    )
    return F.element_at(F.array(*map(F.to_json, events)), kind + 1)


def channel_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels restored in every kind of channel; all but whole texts are split within the label."""
    label, names = "<<REDACTED_PII_0>>", list(CHANNELS)
    kind = ((F.col("conv_id") + F.col("turn")) % len(names)).cast("int")
    t = _turns(spark, sf_dir).select("conv_id", "turn", "role", kind.alias("kind"), F.concat(F.lit(label + " "), F.coalesce("text", F.lit(""))).alias("full"))
    pieces = F.when(F.col("kind") == len(names) - 1, F.array("full")).otherwise(F.array(F.substr("full", F.lit(1), F.lit(7)), F.substr("full", F.lit(8))))
    event = lambda p: F.concat(F.lit("data: "), _channel_event(p, F.col("kind")), F.lit("\n\n"))
    streams = t.select("conv_id", "turn", F.array_join(F.transform(pieces, event), "").alias("body"), F.create_map(F.lit(label), F.col("role")).alias("pairs"))
    restored = sse.rebuilt_streams(streams, ["conv_id", "turn"])
    number = ((F.col("conv_id") + F.col("turn")) % len(names)).cast("int")
    held = lambda payload: F.element_at(F.array(*[F.get_json_object(payload, path) for path in CHANNELS.values()]), number + 1)
    text = F.array_join(F.transform(sse.event_payloads(F.col("body")), held), "")
    return restored.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, names)), number + 1).alias("channel"), text.alias("text"))


def event_type_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events get the line that names their type; the end marker goes."""
    t = _turns(spark, sf_dir)
    body = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("role").alias("type"), "text")), F.lit("\n\ndata: plain\n\ndata: [DONE]\n\n"))
    streams = t.select("conv_id", "turn", body.alias("body"), F.expr("map('', '')").alias("pairs"))
    return sse.rebuilt_streams(streams, ["conv_id", "turn"], with_events=True)


def stream_unredact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of ``sse_rebuild`` through the stateful operator, a file a turn and micro-batch after micro-batch."""
    from maskweave.streaming.holdback import run_once

    return run_once(spark, _turns(spark, sf_dir))


def stream_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that stream, by path: chat and messages paths do, others don't."""
    path = F.element_at(F.array(*map(F.lit, ("/v1/chat/completions", "/v1/messages?x", "/v1/responses"))), (F.col("conv_id") % 3 + 1).cast("int"))
    r = request_bodies(spark, sf_dir)
    return r.select("conv_id", R.stream_eligible(F.lit("POST"), path, F.col("body")).alias("streams"))


def response_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, streamed and failed responses, each the way it goes back."""
    t = _turns(spark, sf_dir)
    label = "<<REDACTED_PII_0>>"
    event = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.lit(label), F.lit('"}}]}\n\n'))
    kind = F.col("turn") % 3
    body = F.when(kind == 0, F.concat(F.lit(" \n"), "text", F.lit(label))).otherwise(event)
    rows = t.select("conv_id", "turn", F.when(kind == 2, 500).otherwise(200).alias("status"), F.when(kind == 0, "application/json").otherwise("Text/Event-Stream; charset=utf-8").alias("content_type"), body.alias("body"), F.create_map(F.lit(label), F.lit("Bob")).alias("pairs"))
    return R.restored(rows, ["conv_id", "turn"])


_FRAGMENTS = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS frag_seq, {} AS text
FROM (SELECT conv_id, turn, unnest(CASE WHEN turn % 2 = 0 THEN [{{'k': 0, 't': text}}] ELSE [{{'k': 0, 't': text}}, {{'k': 1, 't': role}}, {{'k': 2, 't': 'f'}}] END, recursive := true) FROM conversations)
"""
SQL = {
    "fragment_explode": _FRAGMENTS.format("t"),
    "fragment_reassemble": _FRAGMENTS.format("'x:' || t"),
    "fragment_whole_body": "SELECT conv_id, turn, CAST(0 AS BIGINT) AS frag_seq, '{\"input\":' || to_json(text) || ',\"n\":' || turn || '}' AS text FROM conversations",
    "channel_restore": f"SELECT conv_id, turn, {list(CHANNELS)}[(conv_id + turn) % {len(CHANNELS)} + 1] AS channel, role || ' ' || coalesce(text, '') AS text FROM conversations",
    "stream_flag": "SELECT DISTINCT conv_id, true AS stream FROM conversations",
    "sse_parse": """
SELECT conv_id, turn, i AS event_idx, CASE WHEN i = n THEN '[DONE]' ELSE substr(text, i * 9 + 1, 9) END AS content
FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, CAST(greatest(1, ceil(length(text) / 9)) AS BIGINT) AS n FROM conversations))""",
    "sse_channel_concat": "SELECT conv_id, turn, text AS content FROM conversations",
    "sse_redistribute": "SELECT conv_id, turn, CAST(4 AS BIGINT) AS n, text AS joined, least(length(text), greatest(5 * length(text) // 18, 1)) AS n_first FROM conversations",
    "sse_rebuild": "SELECT conv_id, turn, text AS content FROM conversations",
    "stream_unredact": "SELECT conv_id, turn, text AS content FROM conversations",
    "stream_eligibility": "SELECT DISTINCT conv_id, conv_id % 3 < 2 AS streams FROM conversations",
    "response_dispatch": """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || 'Bob' WHEN 1 THEN 'data: {"choices":[{"delta":{"content":"Bob"}}]}' || chr(10) || chr(10)
  ELSE 'data: {"choices":[{"delta":{"content":"<<REDACTED_PII_0>>"}}]}' || chr(10) || chr(10) END AS body FROM conversations""",
    "event_type_normalise": "SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {\"text\":' || to_json(text) || ',\"type\":\"' || role || '\"}' || chr(10) || chr(10) || 'data: plain' || chr(10) || chr(10) AS body FROM conversations",
}
QUERIES = {n: globals()[n] for n in SQL}
