"""Query text in, DataFrame out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tracemill.catalog import Catalog, with_conveniences
from tracemill.functions.scalars import SCALARS, Scalar
from tracemill.plans.lower import Lowering
from tracemill.plans.parser import parse
from tracemill.schema import SIGNALS, TIME


class Engine:
    """A catalog and what lowers queries over it.

    `now` gives the nanoseconds that now() stands for; it is read once a query.
    """

    def __init__(self, spark: SparkSession, now=time.time_ns):
        self.spark, self.now, self.catalog = spark, now, Catalog()
        self.functions: dict[str, Scalar] = dict(SCALARS)

    def register(self, name: str, df: DataFrame, time: str | None = None, ties: tuple[str, ...] = (), partition: tuple[str, int] | None = None) -> "Engine":
        """Add a table; logs, metrics and traces get their convenience columns and time column."""
        if name in SIGNALS:
            df, time = with_conveniences(name, df), time or TIME[name]
        self.catalog.register(name, df, time, ties, partition)
        return self

    def function(self, name: str, build: Callable[..., Column], least: int = 1, most: int | None = None) -> "Engine":
        """Add a scalar function: build gets its first argument as a column, literal later ones as values, and gives a column."""
        self.functions[name.lower()] = (least, least if most is None else most, build)
        return self

    def query(self, text: str, join_hint: str | None = None) -> DataFrame:
        """The result of a statement. join_hint: broadcast, shuffle_hash or merge for its joins; Catalyst decides else, and where a side to broadcast is known to be too large."""
        return Lowering(self.catalog, self.now(), join_hint, self.functions).lower(parse(text))
