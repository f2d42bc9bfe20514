"""The wire format, written by hand and read back."""

import json
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.inputs import _sized
from tracemill.schema import SIGNALS
from tracemill.sources import otlp_binary as ob


def vi(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def msg(*parts):
    """A message of (field, value): int is a varint, float a double, ('fixed', n) fixed64, str and bytes are of any length."""
    out = b""
    for k, v in parts:
        if isinstance(v, tuple):
            out += vi(k << 3 | 1) + struct.pack("<Q", v[1])
        elif isinstance(v, float):
            out += vi(k << 3 | 1) + struct.pack("<d", v)
        elif isinstance(v, int):
            out += vi(k << 3) + vi(v % 2**64)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += vi(k << 3 | 2) + vi(len(v)) + v
    return out


def kv(key, value):
    return msg((1, key), (2, value))


S = lambda x: msg((1, x))


def request(*items):
    scope = msg((1, msg((1, "lib"), (2, "2"))), *((2, i) for i in items), (3, "url"))
    return msg((1, msg((1, msg((1, kv("service.name", S("api"))))), (2, scope))))


def decoded(spark, signal, *requests):
    out = ob.decode(spark.createDataFrame([(r,) for r in requests], "content binary"), signal)
    assert out.schema == SIGNALS[signal]
    return [r.asDict() for r in out.collect()]


@given(st.integers(0, 2**64 - 1))
def test_varints(n):
    assert ob.varint(vi(n) + b"x", 0) == (n, len(vi(n)))


def test_logs(spark):
    array = msg((5, msg((1, msg((3, -4))), (1, msg((2, 1))))))
    record = msg((1, ("fixed", 7)), (2, 17), (3, "ERROR"), (5, S("bröke")), (6, kv("i", msg((3, -5)))), (6, kv("d", msg((4, 1.5)))), (6, kv("a", array)), (6, kv("m", msg((6, msg((1, kv("x", S("y")))))))), (6, kv("b", msg((7, b"\x00\xff")))), (9, b"t" * 16), (10, b"s" * 8), (11, ("fixed", 9)))
    bare = msg((1, ("fixed", 8)), (5, msg((3, 3))), (9, b"short"))
    a, b = decoded(spark, "logs", request(record, bare))
    assert (a["timestamp_ns"], a["observed_timestamp_ns"], a["severity_number"], a["body"], a["scope_name"], a["scope_version"], a["schema_url"]) == (7, 9, 17, "bröke", "lib", "2", "url")
    assert (bytes(a["trace_id"]), bytes(a["span_id"])) == (b"t" * 16, b"s" * 8)
    assert json.loads(a["attributes"]) == {"i": -5, "d": 1.5, "a": [-4, True], "m": {"x": "y"}, "b": "AP8="}
    assert json.loads(a["resource_attributes"]) == {"service.name": "api"}
    assert (b["observed_timestamp_ns"], b["body"], b["trace_id"], b["attributes"], b["severity_text"]) == (8, "3", None, None, None)


@pytest.mark.parametrize("packed", [struct.pack("<3Q", 1, 300, 0), vi(1) + vi(300) + vi(0)])
def test_metrics(spark, packed):
    gauge = msg((1, "cpu"), (3, "1"), (5, msg((1, msg((2, ("fixed", 1)), (3, ("fixed", 2)), (4, 0.5), (7, kv("h", S("x"))))))))
    total = msg((1, "req"), (7, msg((1, msg((3, ("fixed", 3)), (6, ("fixed", 2**64 - 2)))), (2, 2), (3, 1))))
    histogram = msg((1, "lat"), (9, msg((1, msg((3, ("fixed", 4)), (4, ("fixed", 301)), (5, 9.5), (6, packed), (7, struct.pack("<2d", 1.0, 2.0)))))))
    summary = msg((1, "s"), (11, msg((1, msg((3, ("fixed", 5)))))))
    g, t, h = decoded(spark, "metrics", request(gauge, total, histogram, summary))
    assert (g["metric_type"], g["value_double"], g["value_int"], g["start_timestamp_ns"], g["unit"], json.loads(g["attributes"])) == (0, 0.5, None, 1, "1", {"h": "x"})
    assert (t["metric_type"], t["value_double"], t["value_int"], t["timestamp_ns"]) == (1, None, -2, 3)
    assert (h["metric_type"], h["histogram_count"], h["histogram_sum"], h["histogram_bounds"], h["histogram_counts"]) == (2, 301, 9.5, [1.0, 2.0], [1, 300, 0])


def test_traces(spark):
    ids = ((1, b"t" * 16), (2, b"s" * 8))
    span = msg(*ids, (4, b"p" * 8), (5, "GET"), (6, 2), (7, ("fixed", 10**9)), (8, ("fixed", 15 * 10**8)), (11, msg((1, ("fixed", 7)), (2, "e"), (3, kv("k", S("v"))))), (13, msg((1, b"a" * 16), (2, b"b" * 8))), (13, msg((1, b"a"), (2, b"b"))), (15, msg((2, "no"), (3, 2))))
    backwards = msg(*ids, (7, ("fixed", 9)), (8, ("fixed", 2)))
    a, b = decoded(spark, "traces", request(span, backwards, msg((1, b"t" * 16), (2, b"bad")), msg((5, "none"))))
    assert (a["name"], a["kind"], a["duration_ns"], a["status_code"], a["status_message"], bytes(a["parent_span_id"])) == ("GET", 2, 5 * 10**8, 2, "no", b"p" * 8)
    assert json.loads(a["events"]) == [{"timestamp_ns": 7, "name": "e", "attributes": {"k": "v"}}]
    assert json.loads(a["links"]) == [{"trace_id": (b"a" * 16).hex(), "span_id": (b"b" * 8).hex(), "attributes": {}}]
    assert (b["duration_ns"], b["events"], b["links"], b["parent_span_id"]) == (0, "[]", "[]", None)


def test_broken_requests_give_nothing(spark, tmp_path):
    whole = request(msg((1, ("fixed", 7))))
    assert decoded(spark, "logs", b"", None, whole[:-3], b"\xff\xff", b"\x0b") == []
    df = spark.createDataFrame([(i, r) for i, r in enumerate([b"", None, whole[:-3], whole, b"\xff\xff"])], "i int, content binary")
    assert [r.i for r in ob.rejected(df, "logs").collect()] == [2, 4]
    (tmp_path / "a.bin").write_bytes(whole)
    assert ob.read(spark, str(tmp_path), "logs").count() == 1


@pytest.mark.parametrize("n", [0, 1, 100, 127, 128, 5000])
def test_requests_of_fields_in_fields_are_small_plans(spark, n):
    """Each level names its parts once, not once for each use of their length."""
    column, want = F.col("x"), b"a" * n
    for k in range(1, 6):
        column, want = _sized(k, column), msg((k, want))
    df = spark.createDataFrame([("61" * n,)], "x string").select(F.unhex(column).alias("content"))
    assert df._jdf.queryExecution().analyzed().expressions().toString().count("x#") == 1
    assert bytes(df.collect()[0].content) == want
