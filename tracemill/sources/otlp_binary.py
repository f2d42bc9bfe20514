"""OpenTelemetry export requests in protobuf form to the three signals.

Spark's own protobuf reader is a package that isn't always there, so the wire
format is read here: a message is fields of (number, wire type, value), and the
few messages of the protocol are tables of field numbers.  It runs in Arrow
batches where the requests are, and unlike the JSON form it has histograms.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.schema import SIGNALS

Fields = dict[int, list]


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Fields:
    """Field number to its values: ints for varints, bytes for all else. Raises IndexError or ValueError if cut short."""
    out: Fields = {}
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(data, at)
            value, at = data[at : at + size], at + size
            if at > n:
                raise ValueError("message is cut short")
        else:
            raise ValueError(f"wire type {kind}")
        out.setdefault(key >> 3, []).append(value)
    return out


def one(f: Fields, k: int, default=None):
    return f[k][-1] if k in f else default


def number(x, default: int = 0) -> int:
    """A varint or fixed-width whole number, unsigned; below 2**63, as bigint holds it."""
    v = default if x is None else x if isinstance(x, int) else int.from_bytes(x, "little")
    return min(v, 2**63 - 1)


def signed(x) -> int | None:
    if x is None:
        return None
    v = x if isinstance(x, int) else int.from_bytes(x, "little")
    return v - 2**64 if v >= 2**63 else v


def double(x) -> float | None:
    return None if x is None else struct.unpack("<d", x)[0]


def text(x, default: str | None = None) -> str | None:
    return x.decode("utf-8", "replace") if x else default


def any_value(data: bytes):
    f = fields(data)
    if 1 in f:
        return f[1][-1].decode("utf-8", "replace")
    if 2 in f:
        return bool(f[2][-1])
    if 3 in f:
        return signed(f[3][-1])
    if 4 in f:
        return double(f[4][-1])
    if 5 in f:
        return [any_value(v) for v in fields(f[5][-1]).get(1, [])]
    if 6 in f:
        return dict(key_value(v) for v in fields(f[6][-1]).get(1, []))
    if 7 in f:
        return base64.b64encode(f[7][-1]).decode()
    return ""


def key_value(data: bytes) -> tuple[str, object]:
    f = fields(data)
    return text(one(f, 1), ""), any_value(one(f, 2, b""))


def as_json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def attributes(entries: list[bytes]) -> str | None:
    return as_json(dict(map(key_value, entries))) if entries else None


def identifier(x: bytes | None, size: int) -> bytes | None:
    return x if x is not None and len(x) == size else None


def doubles(values: list[bytes]) -> list[float]:
    return [v[0] for b in values for v in struct.iter_unpack("<d", b)]


def counts(values: list, expected: int) -> list[int]:
    """Packed or single counts, fixed-width as the protocol has them, or varints as some write them."""
    out: list[int] = []
    for b in values:
        if isinstance(b, int):
            out.append(b)
        elif len(b) == 8 or len(b) == 8 * expected:
            out += [v[0] for v in struct.iter_unpack("<Q", b)]
        else:
            at = 0
            while at < len(b):
                v, at = varint(b, at)
                out.append(v)
    return out


def _scoped(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(what resource and scope give each row, item) for the items of a request of any signal."""
    for outer in fields(data).get(1, []):
        r = fields(outer)
        resource = attributes(fields(one(r, 1, b"")).get(1, []))
        for inner in r.get(2, []):
            s = fields(inner)
            scope = fields(one(s, 1, b""))
            common = {"resource_attributes": resource, "scope_name": text(one(scope, 1)), "scope_version": text(one(scope, 2)), "schema_url": text(one(s, 3)) or text(one(r, 3))}
            for item in s.get(2, []):
                yield common, item


def logs(data: bytes) -> Iterator[dict]:
    for common, item in _scoped(data):
        f = fields(item)
        at = number(one(f, 1))
        said = any_value(f[5][-1]) if 5 in f else None
        yield common | {
            "timestamp_ns": at, "observed_timestamp_ns": number(one(f, 11)) or at, "trace_id": identifier(one(f, 9), 16), "span_id": identifier(one(f, 10), 8), "severity_number": number(one(f, 2)), "severity_text": text(one(f, 3)),
            "body": said if said is None or isinstance(said, str) else as_json(said), "attributes": attributes(f.get(6, [])),
        }


def metrics(data: bytes) -> Iterator[dict]:
    """Points of gauges (0), sums (1) and histograms (2)."""
    for common, item in _scoped(data):
        m = fields(item)
        named = common | {"name": text(one(m, 1), ""), "description": text(one(m, 2)), "unit": text(one(m, 3))}
        for kind, field in ((0, 5), (1, 7), (2, 9)):
            for point in fields(one(m, field, b"")).get(1, []):
                f = fields(point)
                row = named | {"timestamp_ns": number(one(f, 3)), "start_timestamp_ns": number(one(f, 2)) or None, "metric_type": kind}
                if kind < 2:
                    yield row | {"value_double": double(one(f, 4)), "value_int": signed(one(f, 6)), "attributes": attributes(f.get(7, []))}
                else:
                    bounds = doubles(f.get(7, []))
                    yield row | {"histogram_count": number(one(f, 4)), "histogram_sum": double(one(f, 5)), "histogram_bounds": bounds, "histogram_counts": counts(f.get(6, []), len(bounds) + 1), "attributes": attributes(f.get(9, []))}


def traces(data: bytes) -> Iterator[dict]:
    """Spans with ids of full length."""
    for common, item in _scoped(data):
        f = fields(item)
        trace, span = identifier(one(f, 1), 16), identifier(one(f, 2), 8)
        if trace is None or span is None:
            continue
        start, end = number(one(f, 7)), number(one(f, 8))
        status = fields(one(f, 15, b""))
        events = [{"timestamp_ns": number(one(e, 1)), "name": text(one(e, 2), ""), "attributes": dict(map(key_value, e.get(3, [])))} for e in map(fields, f.get(11, []))]
        links = [{"trace_id": one(k, 1).hex(), "span_id": one(k, 2).hex(), "attributes": dict(map(key_value, k.get(4, [])))} for k in map(fields, f.get(13, [])) if identifier(one(k, 1), 16) and identifier(one(k, 2), 8)]
        yield common | {
            "trace_id": trace, "span_id": span, "parent_span_id": identifier(one(f, 4), 8), "name": text(one(f, 5), ""), "kind": number(one(f, 6)), "start_time_ns": start, "end_time_ns": end, "duration_ns": max(end - start, 0),
            "status_code": number(one(status, 3)), "status_message": text(one(status, 2)), "attributes": attributes(f.get(9, [])), "events": as_json(events), "links": as_json(links),
        }


DECODERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"logs": logs, "metrics": metrics, "traces": traces}


def _parsed(parse: Callable[[bytes], Iterator[dict]], content: bytes | None) -> list[dict] | None:
    """The rows of a request; None if it isn't whole."""
    try:
        return list(parse(content)) if content else []
    except (IndexError, ValueError, struct.error, AttributeError, TypeError):
        return None


def rejected(df: DataFrame, signal: str, column: str = "content") -> DataFrame:
    """The rows whose request isn't whole, and of which `decode` gives nothing."""
    parse = DECODERS[signal]

    @F.arrow_udf("boolean")
    def broken(content: pa.Array) -> pa.Array:
        return pa.array([_parsed(parse, x) is None for x in content.to_pylist()], pa.bool_())

    return df.filter(broken(F.col(column)))


def decode(df: DataFrame, signal: str, column: str = "content") -> DataFrame:
    """The rows of a signal in a binary column of requests. A request that isn't whole gives none: `rejected` has those."""
    schema, parse = SIGNALS[signal], DECODERS[signal]
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Columns, a batch of requests at a time.
            columns: dict[str, list] = {n: [] for n in arrow.names}
            for content in batch.column(0).to_pylist():
                for r in _parsed(parse, content) or ():
                    for n, column in columns.items():
                        column.append(r.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(F.col(column).alias("content")).mapInArrow(rows, schema)


def read(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """A signal from files of one request each."""
    return decode(spark.read.format("binaryFile").load(path), signal)
