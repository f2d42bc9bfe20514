"""The three signals' schemas. Times are nanoseconds since 1970 as bigint, good to the year 2262."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "doubles": T.ArrayType(T.DoubleType()), "longs": T.ArrayType(T.LongType())}


def _schema(text: str) -> T.StructType:
    """From 'name:kind' words; a ! after the kind: not null."""
    return T.StructType([T.StructField(n, _KINDS[k.rstrip("!")], not k.endswith("!")) for n, k in (w.split(":") for w in text.split())])


LOGS = _schema(
    "timestamp_ns:long! observed_timestamp_ns:long! trace_id:binary span_id:binary severity_number:int! severity_text:string body:string attributes:string resource_attributes:string scope_name:string scope_version:string schema_url:string"
)
METRICS = _schema(
    "timestamp_ns:long! start_timestamp_ns:long name:string! description:string unit:string metric_type:byte! value_double:double value_int:long histogram_count:long histogram_sum:double "
    "histogram_bounds:doubles histogram_counts:longs attributes:string resource_attributes:string scope_name:string scope_version:string schema_url:string"
)
TRACES = _schema(
    "trace_id:binary! span_id:binary! parent_span_id:binary name:string! kind:int! start_time_ns:long! end_time_ns:long! duration_ns:long! status_code:int! status_message:string "
    "attributes:string resource_attributes:string scope_name:string scope_version:string events:string links:string schema_url:string"
)
SIGNALS = {"logs": LOGS, "metrics": METRICS, "traces": TRACES}
TIME = {"logs": "timestamp_ns", "metrics": "timestamp_ns", "traces": "start_time_ns"}
METRIC_TYPES = ("gauge", "sum", "histogram", "exponential_histogram", "summary")
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUS_CODES = ("unset", "ok", "error")
TEMPORALITIES = ("unspecified", "delta", "cumulative")
_SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def severity_name(number: Column) -> Column:
    """TRACE to FATAL for 1 to 24, by fours; UNSPECIFIED else."""
    names = F.array(*[F.lit(s) for s in _SEVERITIES])
    return F.when(number.between(1, 24), F.element_at(names, (F.floor((number - 1) / 4) + 1).cast("int"))).otherwise("UNSPECIFIED")
