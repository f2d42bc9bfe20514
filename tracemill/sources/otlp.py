"""OpenTelemetry JSON to the three signals, in batch or streaming.

Input is a column of JSON text, one export request a row.  A request is read by
one from_json with a fixed schema and exploded.  Attribute values that are text,
numbers, truth values or bytes become JSON by built-in functions.  Arrays and
key-value lists, which nest to any depth, stay the text that they came as until
then; the attributes that hold one are converted together in Arrow batches, and
for all others that step gets nulls.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.schema import LOGS, METRICS, TRACES

#: A value; arrays and key-value lists stay JSON text.
_VALUE = "struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double, bytesValue: string, arrayValue: string, kvlistValue: string>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
_SCOPE = "struct<name: string, version: string>"
_RESOURCE = f"struct<attributes: {_ATTRIBUTES}>"
_LOG = f"struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {_VALUE}, attributes: {_ATTRIBUTES}, traceId: string, spanId: string>"
_POINT = f"struct<timeUnixNano: string, startTimeUnixNano: string, asDouble: double, asInt: string, attributes: {_ATTRIBUTES}>"
_METRIC = f"struct<name: string, description: string, unit: string, gauge: struct<dataPoints: array<{_POINT}>>, sum: struct<dataPoints: array<{_POINT}>>>"
_LINK = f"struct<traceId: string, spanId: string, attributes: {_ATTRIBUTES}>"
_EVENT = f"struct<timeUnixNano: string, name: string, attributes: {_ATTRIBUTES}>"
_SPAN = (
    f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: string, message: string>, "
    f"attributes: {_ATTRIBUTES}, events: array<{_EVENT}>, links: array<{_LINK}>>"
)


def plain(value: object) -> object:
    """A decoded value without its type names, at any depth; what has none is the empty string."""
    if not isinstance(value, dict):
        return ""
    for kind in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue"):
        x = value.get(kind)
        if x is None:
            continue
        if kind in ("arrayValue", "kvlistValue"):
            x = json.loads(x) if isinstance(x, str) else x
            listed = x.get("values") or [] if isinstance(x, dict) else []
            return [plain(v) for v in listed] if kind == "arrayValue" else entries(listed)
        if kind == "intValue":
            try:
                return int(x)
            except ValueError:
                continue
        return x
    return ""


def entries(listed: list) -> dict:
    return {e["key"]: plain(e.get("value")) for e in listed if isinstance(e, dict) and isinstance(e.get("key"), str)}


def _dumped(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _event(e: dict) -> dict:
    return {"timestamp_ns": _whole(e.get("timeUnixNano")), "name": e.get("name") or "", "attributes": entries(e.get("attributes") or [])}


def _link(k: dict) -> dict:
    return {"trace_id": k["traceId"].lower(), "span_id": k["spanId"].lower(), "attributes": entries(k.get("attributes") or [])}


def _whole(x: object) -> int:
    try:
        return int(x)
    except (TypeError, ValueError):
        return 0


_SHAPES = {"value": plain, "attributes": entries, "events": lambda x: [_event(e) for e in x], "links": lambda x: [_link(k) for k in x]}


def _nested(shape: str):
    """JSON of typed values to plain JSON; nulls stay. Values nested too deep for the interpreter stay as they came."""

    @F.arrow_udf("string")
    def convert(text: pa.Array) -> pa.Array:
        if text.null_count == len(text):
            return text.cast(pa.string())
        out = []
        for t in text.to_pylist():
            try:
                out.append(None if t is None else _dumped(_SHAPES[shape](json.loads(t))))
            except RecursionError:
                out.append(t)
        return pa.array(out, pa.string())

    return convert


def quote(x: Column) -> Column:
    """Text as a JSON string."""
    one = F.to_json(F.array(x))
    # Most texts have nothing to escape.
    return F.when(x.rlike(r'["\\\x00-\x1f\x7f-\x{10ffff}]'), F.substring(one, F.lit(2), F.length(one) - 2)).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


def holds_more(v: Column) -> Column:
    """Whether a value is an array or a key-value list."""
    return v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull()


def any_hold_more(listed: Column) -> Column:
    return F.coalesce(F.exists(listed, lambda e: F.coalesce(holds_more(e["value"]), F.lit(False))), F.lit(False))


def any_value(v: Column) -> Column:
    """A value that isn't nested as plain JSON. Missing values are the empty string."""
    whole = v["intValue"].try_cast("long")
    return (
        F.when(v["stringValue"].isNotNull(), quote(v["stringValue"]))
        .when(v["boolValue"].isNotNull(), v["boolValue"].cast("string"))
        .when(whole.isNotNull(), whole.cast("string"))
        .when(v["doubleValue"].isNotNull(), v["doubleValue"].cast("string"))
        .when(v["bytesValue"].isNotNull(), quote(v["bytesValue"]))
        .otherwise(F.lit('""'))
    )


def flat(listed: Column) -> Column:
    """Key-value entries without nested values as the text of a JSON object."""
    each = F.transform(F.filter(listed, lambda e: e["key"].isNotNull()), lambda e: F.concat(quote(e["key"]), F.lit(":"), any_value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def attributes(listed: Column) -> Column:
    """Key-value entries as the text of a JSON object; null for none."""
    more = any_hold_more(listed)
    return F.when(F.size(listed) > 0, F.coalesce(_nested("attributes")(F.when(more, F.to_json(listed))), flat(listed)))


def body(v: Column) -> Column:
    """Text bodies as they are, others as JSON."""
    return F.when(v.isNull(), None).when(v["stringValue"].isNotNull(), v["stringValue"]).otherwise(F.coalesce(_nested("value")(F.when(holds_more(v), F.to_json(v))), any_value(v)))


def nanos(x: Column) -> Column:
    """A number or a decimal string; 0 else."""
    return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))


def filled(x: Column) -> Column:
    """Null for empty text."""
    return F.when(x != "", x)


def hex_id(x: Column, digits: int) -> Column:
    """The bytes of an id of so many hexadecimal digits; null else."""
    return F.when(x.rlike(f"^[0-9a-fA-F]{{{digits}}}$"), F.unhex(x))


def _entries(df: DataFrame, column: str, outer: str, scopes: str, items: str, item: str) -> DataFrame:
    """A row for each item, with what its resource and scope give it; resources are converted once, not for each item."""
    shape = f"{outer} array<struct<resource: {_RESOURCE}, schemaUrl: string, {scopes}: array<struct<scope: {_SCOPE}, schemaUrl: string, {items}: array<{item}>>>>>"
    a = df.select(F.explode(F.from_json(F.col(column), shape)[outer]).alias("r"))
    b = a.select(attributes(F.col("r.resource.attributes")).alias("resource_attributes"), F.col("r.schemaUrl").alias("url"), F.explode(f"r.{scopes}").alias("s"))
    return b.select(
        "resource_attributes", filled(F.col("s.scope.name")).alias("scope_name"), filled(F.col("s.scope.version")).alias("scope_version"),
        F.coalesce(filled(F.col("s.schemaUrl")), filled(F.col("url"))).alias("schema_url"), F.explode(f"s.{items}").alias("x"))


_GIVEN = ("resource_attributes", "scope_name", "scope_version", "schema_url")


def rejected(df: DataFrame, column: str = "value") -> DataFrame:
    """The rows that are no request: text that isn't JSON, or JSON that isn't an object. The decoders give nothing for them."""
    kind = F.schema_of_variant(F.try_parse_json(F.trim(F.col(column))))
    return df.filter(F.coalesce(~kind.startswith("OBJECT"), F.lit(True)))


def _as(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def logs(df: DataFrame, column: str = "value") -> DataFrame:
    x = _entries(df, column, "resourceLogs", "scopeLogs", "logRecords", _LOG)
    at = nanos(F.col("x.timeUnixNano"))
    seen = nanos(F.col("x.observedTimeUnixNano"))
    return _as(x.select(
        at.alias("timestamp_ns"), F.when(seen > 0, seen).otherwise(at).alias("observed_timestamp_ns"), hex_id(F.col("x.traceId"), 32).alias("trace_id"), hex_id(F.col("x.spanId"), 16).alias("span_id"),
        F.coalesce("x.severityNumber", F.lit(0)).alias("severity_number"), filled(F.col("x.severityText")).alias("severity_text"), body(F.col("x.body")).alias("body"), attributes(F.col("x.attributes")).alias("attributes"), *_GIVEN), LOGS)


def metrics(df: DataFrame, column: str = "value") -> DataFrame:
    """Points of gauges (type 0) and sums (type 1); other kinds have no rows in JSON."""
    m = _entries(df, column, "resourceMetrics", "scopeMetrics", "metrics", _METRIC)
    arms = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"x.{k}.dataPoints").alias("points")) for i, k in enumerate(("gauge", "sum"))])
    one = m.select(*_GIVEN, F.col("x.name").alias("name"), F.col("x.description").alias("description"), F.col("x.unit").alias("unit"), F.explode(arms).alias("arm"))
    x = one.select(*_GIVEN, "name", "description", "unit", F.col("arm.kind").alias("metric_type"), F.explode("arm.points").alias("x"))
    start = nanos(F.col("x.startTimeUnixNano"))
    none = F.lit(None)
    return _as(x.select(
        nanos(F.col("x.timeUnixNano")).alias("timestamp_ns"), F.when(start > 0, start).alias("start_timestamp_ns"), F.coalesce("name", F.lit("")).alias("name"), filled(F.col("description")).alias("description"), filled(F.col("unit")).alias("unit"), "metric_type",
        F.col("x.asDouble").alias("value_double"), F.col("x.asInt").try_cast("long").alias("value_int"), none.alias("histogram_count"), none.alias("histogram_sum"), none.alias("histogram_bounds"), none.alias("histogram_counts"),
        attributes(F.col("x.attributes")).alias("attributes"), *_GIVEN), METRICS)


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _or_empty(listed: Column) -> Column:
    return F.when(F.size(listed) > 0, flat(listed)).otherwise("{}")


def traces(df: DataFrame, column: str = "value") -> DataFrame:
    """Spans whose ids are hexadecimal and of full length; a span that ends before it starts lasts 0."""
    x = _entries(df, column, "resourceSpans", "scopeSpans", "spans", _SPAN)
    start, end = nanos(F.col("x.startTimeUnixNano")), nanos(F.col("x.endTimeUnixNano"))
    events = F.coalesce("x.events", F.array().cast(f"array<{_EVENT}>"))
    links = F.filter(F.coalesce("x.links", F.array().cast(f"array<{_LINK}>")), lambda k: hex_id(k["traceId"], 32).isNotNull() & hex_id(k["spanId"], 16).isNotNull())
    more = lambda listed: F.when(F.exists(listed, lambda e: any_hold_more(e["attributes"])), F.to_json(listed))
    flat_events = F.transform(events, lambda e: F.concat(F.lit('{"timestamp_ns":'), nanos(e["timeUnixNano"]).cast("string"), F.lit(',"name":'), quote(F.coalesce(e["name"], F.lit(""))), F.lit(',"attributes":'), _or_empty(e["attributes"]), F.lit("}")))
    flat_links = F.transform(links, lambda k: F.concat(F.lit('{"trace_id":'), quote(F.lower(k["traceId"])), F.lit(',"span_id":'), quote(F.lower(k["spanId"])), F.lit(',"attributes":'), _or_empty(k["attributes"]), F.lit("}")))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    good = x.filter(hex_id(F.col("x.traceId"), 32).isNotNull() & hex_id(F.col("x.spanId"), 16).isNotNull())
    return _as(good.select(
        hex_id(F.col("x.traceId"), 32).alias("trace_id"), hex_id(F.col("x.spanId"), 16).alias("span_id"), hex_id(F.col("x.parentSpanId"), 16).alias("parent_span_id"), F.coalesce("x.name", F.lit("")).alias("name"), number("x.kind").alias("kind"),
        start.alias("start_time_ns"), end.alias("end_time_ns"), F.greatest(end - start, F.lit(0).cast("long")).alias("duration_ns"), number("x.status.code").alias("status_code"), filled(F.col("x.status.message")).alias("status_message"),
        attributes(F.col("x.attributes")).alias("attributes"), F.coalesce(_nested("events")(more(events)), _listed(flat_events)).alias("events"), F.coalesce(_nested("links")(more(links)), _listed(flat_links)).alias("links"), *_GIVEN), TRACES)


DECODERS = {"logs": logs, "metrics": metrics, "traces": traces}


def read(spark: SparkSession, path: str, signal: str, lines: bool = False) -> DataFrame:
    """A signal from files of one request each, or of one request a line."""
    return DECODERS[signal](spark.read.text(path, wholetext=not lines))
