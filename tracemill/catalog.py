"""Tables by name, with what the query language has to know of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.errors import BindError


@dataclass(frozen=True)
class Table:
    df: DataFrame
    #: Column of nanoseconds that orders rows; of time bounds and delta().
    time: str | None = None
    #: Columns that break ties of time.
    ties: tuple[str, ...] = ()
    #: (partition column, its width in nanoseconds): it holds time - time % width.
    partition: tuple[str, int] | None = None


def widened(df: DataFrame) -> DataFrame:
    """Unsigned 64-bit Parquet columns, which Spark reads as decimal(20,0), as bigint."""
    wide = [f.name for f in df.schema.fields if f.dataType == T.DecimalType(20, 0)]
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in wide}) if wide else df


def with_conveniences(signal: str, df: DataFrame) -> DataFrame:
    """The names that people use besides the stored ones: service_name, metric_name, value, timestamp_ns."""
    have, new = set(df.columns), {}
    if "resource_attributes" in have and "service_name" not in have:
        new["service_name"] = F.get_json_object("resource_attributes", "$['service.name']")
    if signal == "metrics":
        if "metric_name" not in have:
            new["metric_name"] = F.col("name")
        if "value" not in have and {"value_double", "value_int"} <= have:
            new["value"] = F.coalesce("value_double", F.col("value_int").cast("double"))
    if signal == "traces" and "timestamp_ns" not in have:
        new["timestamp_ns"] = F.col("start_time_ns")
    return df.withColumns(new) if new else df


class Catalog:
    def __init__(self, below: "Catalog | None" = None) -> None:
        """below: a catalog whose tables are here too, unless there are others of their names."""
        self._tables: dict[str, Table] = dict(below._tables) if below else {}

    def register(self, name: str, df: DataFrame, time: str | None = None, ties: tuple[str, ...] = (), partition: tuple[str, int] | None = None) -> None:
        self._tables[name] = Table(widened(df), time, ties, partition)

    def table(self, name: str) -> Table:
        if name not in self._tables:
            raise BindError(f"unknown table {name!r}; there are {', '.join(sorted(self._tables)) or 'none'}")
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def columns(self, name: str) -> list[tuple[str, str, bool]]:
        """(name, type, nullable) of each column."""
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(name).df.schema.fields]
