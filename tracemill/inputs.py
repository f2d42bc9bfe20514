"""The test tables as signals, requests and folders, for the registered queries.

events stand for logs and metrics, lineitem for traces.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.engine import Engine

DAY, HOUR = 86400 * 10**9, 3600 * 10**9
T0, T1, T2 = 1704844800 * 10**9, 1705708800 * 10**9, 1706659200 * 10**9
NOW = T2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("timestamp_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ns(spark, sf_dir).select("event_id", "timestamp_ns", "user_id", "event_type", "value")


def engine(spark: SparkSession, sf_dir: str, tables: set[str] | None = None) -> Engine:
    """An engine over the tables that are asked for; all without."""
    out = Engine(spark, now=lambda: NOW)
    asked = lambda name: tables is None or name in tables
    if asked("logs"):
        severity = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).when(F.col("event_type") == "signup", 9).otherwise(5)
        text = F.when(F.col("event_type") != "click", F.col("event_type"))
        e = events_ns(spark, sf_dir).select(
            "timestamp_ns", "event_id", severity.alias("severity_number"), text.alias("severity_text"), F.col("event_type").alias("body"), F.col("props").alias("attributes"), "user_id")
        out.register("logs", e, ties=("event_id",))
    if asked("metrics"):
        e = events_ns(spark, sf_dir).select("timestamp_ns", "event_id", F.col("event_type").alias("name"), F.col("value").alias("value_double"), F.lit(None).cast("long").alias("value_int"), "user_id")
        out.register("metrics", e, ties=("event_id",))
    if asked("traces"):
        start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
        e = read(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_returnflag").alias("name"), start.alias("start_time_ns"),
            (F.col("l_quantity") * 1e6).cast("long").alias("duration_ns"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("price"))
        out.register("traces", e)
    for name in ("orders", "customer", "nation", "region", "supplier", "part"):
        if asked(name):
            out.register(name, read(spark, sf_dir, name))
    return out


WITH = """WITH logs AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_id, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 ELSE 5 END AS severity_number,
  CASE WHEN event_type <> 'click' THEN event_type END AS severity_text, event_type AS body, props AS attributes, user_id FROM events),
metrics AS (SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_id, event_type AS name, event_type AS metric_name, value AS value_double, value, user_id FROM events),
traces AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, l_returnflag AS name, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS start_time_ns, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS timestamp_ns,
  CAST(l_quantity * 1e6 AS BIGINT) AS duration_ns, l_linestatus AS status, l_extendedprice AS price FROM lineitem)
"""
M = "m AS (SELECT event_id, epoch_us(ts) * 1000 AS timestamp_ns, user_id, event_type, value FROM events)"


def json_requests(spark: SparkSession, sf_dir: str, signal: str, body: Column | None = None, where: str = "true") -> DataFrame:
    """Those events as export requests in JSON, one each. body: the JSON of the logs' bodies."""
    e = events_ns(spark, sf_dir).filter(where)
    t, user = F.col("timestamp_ns").cast("string"), (F.col("user_id") % 5).cast("string")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    body = F.concat(F.lit('{"stringValue":"'), kind, F.lit('"}')) if body is None else body
    resource = F.concat(F.lit('"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc'), user, F.lit('"}}]}'))
    end = (F.col("timestamp_ns") + F.floor((F.col("value") - 50) * 1000).cast("long")).cast("string")
    trace = F.concat(F.when(F.col("event_id") % 7 == 0, F.lit("g")).otherwise(F.lit("0")), F.lpad(F.lower(F.hex("event_id")), 31, "0"))
    outer, scopes, items, item = {
        "logs": ("resourceLogs", "scopeLogs", "logRecords", [
            '{"timeUnixNano":"', t, '","severityNumber":9,"body":', body, ',"attributes":[{"key":"id","value":{"intValue":"', number, '"}}]}']),
        "metrics": ("resourceMetrics", "scopeMetrics", "metrics", [
            '{"name":"', kind, '","gauge":{"dataPoints":[{"timeUnixNano":', t, ',"asDouble":', F.col("value").cast("string"), ',"attributes":[]}]}}']),
        "traces": ("resourceSpans", "scopeSpans", "spans", [
            '{"traceId":"', trace, '","spanId":"', F.lpad(F.lower(F.hex("user_id")), 16, "0"), '","parentSpanId":"","name":"', kind, '","kind":2,"startTimeUnixNano":"', t, '","endTimeUnixNano":"', end, '","status":{"code":1}}']),
    }[signal]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in item])
    return e.select(F.concat(F.lit(f'{{"{outer}":[{{'), resource, F.lit(f',"{scopes}":[{{"scope":{{"name":"test"}},"{items}":['), text, F.lit("]}]}]}")).alias("value"))


def _tag(field: int, wire: int) -> str:
    return f"{field << 3 | wire:02X}"


def _byte(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def _sized(field: int, *parts: Column) -> Column:
    """A field of bytes, in hexadecimal; below 16 KB."""

    def prefixed(whole: Column) -> Column:
        n = (F.length(whole) / 2).cast("int")
        return F.concat(F.lit(_tag(field, 2)), F.when(n < 128, _byte(n)).otherwise(F.concat(_byte(n.bitwiseAND(127).bitwiseOR(128)), _byte(F.shiftright(n, 7)))), whole)

    # A variable, not the parts again and again: fields in fields would multiply them at each level.
    return F.transform(F.array(F.concat(*parts)), prefixed)[0]


def _text(field: int, x: Column) -> Column:
    return _sized(field, F.hex(x.cast("string")))


def _fixed(field: int, x: Column) -> Column:
    """A field of eight bytes, lowest first."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(F.lit(_tag(field, 1)), *[F.substring(h, k, 2) for k in range(15, 0, -2)])


def _small(field: int, n: int) -> Column:
    return F.lit(f"{_tag(field, 0)}{n:02X}")


def _entry(field: int, key: str, value: Column) -> Column:
    return _sized(field, _text(1, F.lit(key)), _sized(2, _text(1, value)))


def binary_requests(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """events as export requests in protobuf form, one each, in a column `content`."""
    e, t, kind, number = events_ns(spark, sf_dir), F.col("timestamp_ns"), F.col("event_type"), F.col("event_id")
    items = {
        "logs": [_sized(2, _fixed(1, t), _small(2, 9), _sized(5, _text(1, kind)), _entry(6, "id", number))],
        "metrics": [_sized(2, _text(1, kind), _sized(5, _sized(1, _fixed(3, t), _fixed(6, number)))), _sized(2, _text(1, F.lit("h")), _sized(9, _sized(1, _fixed(3, t), _fixed(4, F.col("user_id")))))],
        "traces": [_sized(2, _sized(1, F.lpad(F.hex(number), 32, "0")), _sized(2, F.lpad(F.hex("user_id"), 16, "0")), _text(5, kind), _small(6, 2), _fixed(7, t), _fixed(8, t + number), _sized(15, _small(3, 1)))],
    }[signal]
    resource = _sized(1, _entry(1, "service.name", F.concat(F.lit("svc"), F.col("user_id") % 5)))
    return e.select(F.unhex(_sized(1, resource, _sized(2, _sized(1, _text(1, F.lit("test"))), *items))).alias("content"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, and only on one machine in a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tracemill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return f"{base}/tracemill-{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str) -> DataFrame:
    """df as a checkpoint; the folder that it was read from is deleted."""
    out = df.checkpoint()
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out
