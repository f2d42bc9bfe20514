"""Scalar functions of the query language: name to (least, most arguments, builder).

A builder gets its first argument as a column and literal later ones as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import temporal
from tracemill.schema import severity_name

Scalar = tuple[int, int, Callable[..., Column]]


def natural_log(x: Column) -> Column:
    """Minus infinity of zero and NaN below it, as IEEE 754 has it; Spark's gives null for both."""
    x = x.cast("double")
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


SCALARS: dict[str, Scalar] = {
    "round": (1, 2, lambda x, n=0: F.round(x.cast("double"), n)),
    "abs": (1, 1, F.abs),
    "floor": (1, 1, F.floor),
    "ceil": (1, 1, F.ceil),
    "sqrt": (1, 1, F.sqrt),
    "ln": (1, 1, natural_log),
    "exp": (1, 1, F.exp),
    "lower": (1, 1, F.lower),
    "upper": (1, 1, F.upper),
    "length": (1, 1, F.length),
    "trim": (1, 1, F.trim),
    "hex": (1, 1, lambda x: F.lower(F.hex(x))),
    "coalesce": (1, 99, lambda *x: F.coalesce(*[v if isinstance(v, Column) else F.lit(v) for v in x])),
    "json": (2, 2, F.get_json_object),
    "severity": (1, 1, severity_name),
    "bucket_quantile": (3, 3, lambda bounds, counts, q: temporal.bucket_quantile(q, bounds, counts)),
}
