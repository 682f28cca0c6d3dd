"""Structured Streaming: encode arriving items under a frozen encoder, and event-time windows.

Encoding is a projection, so the stream is stateless and gives the same codes as a batch. Programs are literals of the
projection, so a scored stream needs no state either. Windows keep state up to the watermark only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetrank.operators.encode import Encoder, encode
from facetrank.operators.program import Program


def encode_stream(items: DataFrame, encoder: Encoder, embedding: str = "embedding") -> DataFrame:
    return encode(items, encoder, embedding)


def score_stream(items: DataFrame, encoder: Encoder, programs: dict[str, Program], embedding: str = "embedding") -> DataFrame:
    """Codes, and one log probability a program."""
    coded = encode(items, encoder, embedding)
    return coded.withColumns({f"logp_{n}": p.log_prob() for n, p in programs.items()})


def write_codes(coded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append codes to an index as they arrive; exactly once, by the file sink's log."""
    return coded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def without_tombstones(deleted: DataFrame, row_id: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves out rows whose id has been deleted."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(batch.join(deleted.select(row_id).distinct(), row_id, "left_anti"), epoch)

    return run


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, kind, n, total) of event-time windows; with a watermark where ``late`` is given."""
    rows = events.withWatermark(ts, late) if late else events
    counted = rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    counted = rows.groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, session_start, session_end, n): runs of a user's events with no gap of that length."""
    rows = events.withWatermark(ts, late) if late else events
    counted = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
