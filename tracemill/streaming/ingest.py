"""Continuous ingest and stateful queries with Structured Streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.schema import TIME
from tracemill.sources import store
from tracemill.sources.otlp import DECODERS
from tracemill.sources.store import HOUR


def incoming(spark: SparkSession, landing: str, signal: str, files_per_trigger: int = 1000, lines: bool = False, bytes_per_trigger: int | None = None) -> DataFrame:
    """The rows of export requests that arrive as files in a folder, one a file or one a line. A full folder waits; nothing is dropped.

    What is taken at a time is bounded by files_per_trigger or, if given, by
    bytes_per_trigger: the size at which what has arrived is written out.
    """
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger is not None else ("maxFilesPerTrigger", files_per_trigger)
    raw = spark.readStream.schema("value string").option("wholetext", not lines).option(*limit).text(landing)
    return DECODERS[signal](raw)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint over restarts."""
    Path, fs = store._fs(spark, checkpoint)
    return json.loads(store._read_text(spark, fs, Path(f"{checkpoint}/metadata")))["id"]


def ingest(spark: SparkSession, landing: str, path: str, checkpoint: str, signal: str, width: int = HOUR, files_per_trigger: int = 1000, every: str | None = None, lines: bool = False, bytes_per_trigger: int | None = None) -> StreamingQuery:
    """Write what arrives to the store, each row to its own hour however late.

    The checkpoint holds what was read.  Each batch is a commit of the store,
    named by the stream and the batch's number: a batch that is repeated after a
    failure is written once, so a restart goes on without loss or repeats, and
    batches, streams and compaction may use one store.  every: a trigger
    interval; without one, all that is there is taken and the query ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        store.write(batch, signal, path, width, commit=f"{_query_id(spark, checkpoint)}-{number}")

    out = incoming(spark, landing, signal, files_per_trigger, lines, bytes_per_trigger).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def event_time(df: DataFrame, signal: str) -> DataFrame:
    """df with event_time, its time column as a timestamp of microseconds."""
    ns = F.col(TIME[signal])
    # Whole numbers throughout: nanoseconds have more digits than a double holds.
    return df.withColumn("event_time", F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))))


def windowed_counts(df: DataFrame, signal: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows by window and key, once the window is `late` past."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return event_time(df, signal).withWatermark("event_time", late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(df: DataFrame, signal: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions by key: rows no further apart than gap."""
    return event_time(df, signal).withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(df: DataFrame, signal: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key among those that arrive within `late` of each other."""
    return event_time(df, signal).withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys).drop("event_time")


def join_within(left: DataFrame, right: DataFrame, signal: str, by: list[str], within: str, late: str) -> DataFrame:
    """Two streams joined: each left row with the right rows of the same `by` up to `within` later, as right_<column>.

    Rows are held until no partner can come any more: both sides' lateness and
    the width bound the state.
    """
    a = event_time(left, signal).withWatermark("event_time", late)
    b = event_time(right, signal).withWatermark("event_time", late).select(*[F.col(c).alias(f"right_{c}") for c in [*right.columns, "event_time"]])
    on = (F.col("right_event_time") >= F.col("event_time")) & (F.col("right_event_time") <= F.col("event_time") + F.expr(f"INTERVAL {within}"))
    for c in by:
        on = on & (F.col(c) == F.col(f"right_{c}"))
    return a.join(b, on).drop("event_time", "right_event_time")
