"""Event streams as rows: framing on the JVM, restoring through Arrow batches."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.constants import LABEL_MARK
from maskweave.functions import events as E
from maskweave.functions.core import fold

#: Streams of an Arrow batch that are texts in Python at a time.
AT_A_TIME = 200


def event_payloads(body: Column) -> Column:
    """Payloads of a whole stream's events: data lines joined, blank events dropped."""
    blocks = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n\n")
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.transform(blocks, lambda b: F.array_join(F.transform(lines(b), lambda x: F.ltrim(F.substr(x, F.lit(6)), F.lit(" \t"))), ""))
    return F.filter(data, lambda d: F.btrim(d, F.lit(" \t\r\n")) != "")


def chat_content(payload: Column) -> Column:
    """The content of the first choice of a chat event, null for other events."""
    return F.get_json_object(payload, "$.choices[0].delta.content")


def redistributed(text: Column, lengths: Column) -> Column:
    """A text spread over pieces in proportion to their lengths, as JVM-side expressions."""
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)

    def step(a: Column, x: Column) -> Column:
        left = F.length(text) - a["at"]
        share = F.floor(x["n"] * F.length(text) / F.greatest(total, F.lit(1))).cast("int")
        take = F.when(x["last"], left).otherwise(F.least(left, F.greatest(share, F.when(left > 0, 1).otherwise(0))))
        return F.struct((a["at"] + take).alias("at"), F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, take))).alias("out"))

    marked = F.transform(lengths, lambda n, i: F.struct(n.alias("n"), (i == F.size(lengths) - 1).alias("last")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(total == 0, F.transform(lengths, lambda n: F.lit(""))).otherwise(fold(marked, start, step)["out"])


def rebuilt_streams(streams: DataFrame, key: list[str], body: str = "body", pairs: str = "pairs", with_events: bool = False) -> DataFrame:
    """(key, body) with restored texts. ``pairs``: a map of label to original. Streams that can't hold a label pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_A_TIME):
                b = whole.slice(at, AT_A_TIME)
                out = []
                for text, held in zip(b.column(body), b.column(pairs)):
                    payloads, rest = E.frame(text.as_py())
                    done = E.rebuild([*payloads, *E.flushed(rest)], E.restorer(dict(held.as_py() or ())))
                    out.append(E.with_event_lines(done) if with_events else E.serialise(done))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array(out, pa.string())], names=[*key, body])

    schema = ", ".join(f"`{k}` {streams.schema[k].dataType.simpleString()}" for k in key) + f", `{body}` string"
    marked = F.contains(body, F.lit(LABEL_MARK[0])) | F.contains(body, F.lit("\\u003"))  # a label may be split anywhere, or escaped
    changed = streams if with_events else streams.where(marked)
    out = changed.select(*key, body, pairs).mapInArrow(run, schema)
    return out if with_events else out.unionByName(streams.where(~marked).select(*key, body))
