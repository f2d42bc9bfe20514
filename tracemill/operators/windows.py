"""Windows over series: rolling z-scores, changes, sessions, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_z(df: DataFrame, value: str, order: list[str], by: list[str], rows: int, out: str = "z") -> DataFrame:
    """df with the z-score of value among itself and the `rows` rows before it, population deviation; null where that is 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, 0)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def change(df: DataFrame, value: str, time: str, order: list[str], by: list[str], out: str = "change") -> DataFrame:
    """df with the change of value per second since the row before; null for the first, and for rows of one time."""
    w = Window.partitionBy(*by).orderBy(*order)
    seconds = (F.col(time) - F.lag(time).over(w)) / F.lit(1e9)
    return df.withColumn(out, F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds))


def sessions(df: DataFrame, time: str, order: list[str], by: list[str], gap_ns: int, out: str = "session") -> DataFrame:
    """df with the number of its session within `by`, from 1; a gap of more than gap_ns begins another."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (F.col(time) - F.lag(time).over(w) > gap_ns) | F.lag(time).over(w).isNull()
    return df.withColumn("__new", new.cast("int")).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups down before it moves them."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")
