"""Root-cause work on a result: anomalies, correlations, and a report."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_LIMIT, R_LIMIT, LEAST_ROWS = 3.0, 0.8, 3
NO_DATA = "No data returned by the query."
_BASIC = (T.NumericType, T.StringType, T.BooleanType)


def as_number(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose every value can be read as a number: no null, and text only where all of it is numeric. One pass."""
    asked = [f.name for f in df.schema.fields if isinstance(f.dataType, _BASIC)]
    if not asked:
        return []
    row = df.agg(F.count("*").alias("n"), *[F.count(as_number(df, c)).alias(f"c{i}") for i, c in enumerate(asked)]).first()
    return [c for i, c in enumerate(asked) if row["n"] and row[f"c{i}"] == row["n"]]


def anomalies(df: DataFrame, columns: list[str], keys: list[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """keys, column, value, z: values more than `limit` population deviations from their column's mean; z to 2 places.

    One aggregation and one pass: the columns' means and deviations are one row.
    """
    shape = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "column string, value double, z double"])
    if not columns:
        return df.sparkSession.createDataFrame([], shape)
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(as_number(df, c)).alias(f"m{i}"), F.stddev_pop(as_number(df, c)).alias(f"s{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_number(df, c).alias("value"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)]))
    long = df.crossJoin(F.broadcast(stats)).select(*keys, each.alias("e")).select(*keys, "e.*").filter("s > 0")
    return long.withColumn("z", F.abs(F.col("value") - F.col("m")) / F.col("s")).filter(F.col("z") > limit).select(*keys, "column", "value", F.round("z", 2).alias("z"))


def pearson(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are known; null where either is constant (corr is an error there)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str], limit: float = R_LIMIT) -> DataFrame:
    """a, b, r of each pair of columns with |r| of `limit` at least, over LEAST_ROWS rows at least; r to 3 places. One aggregation."""
    pairs = list(combinations(columns, 2))
    shape = "a string, b string, r double"
    if not pairs:
        return df.sparkSession.createDataFrame([], shape)
    r = df.agg(F.count("*").alias("n"), *[pearson(as_number(df, a), as_number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return r.filter(F.col("n") >= LEAST_ROWS).select(each.alias("e")).select("e.*").filter(F.abs("r") >= limit).select("a", "b", F.round("r", 3).alias("r"))


def lag_correlations(df: DataFrame, time: str, a: str, b: str, bucket_ns: int, lags: range) -> DataFrame:
    """lag, n, r: Pearson r of a's bucket means with b's, lag buckets later; one row a lag."""
    at = F.col(time)
    means = df.groupBy(F.call_function("div", at - F.pmod(at, F.lit(bucket_ns)), F.lit(bucket_ns)).alias("t")).agg(F.avg(a).alias("a"), F.avg(b).alias("b"))
    shifted = means.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "t", "a").select("lag", (F.col("t") + F.col("lag")).alias("t"), "a")
    return shifted.join(means.select("t", "b"), "t").groupBy("lag").agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("r"))


def significant(lags: DataFrame, least_r: float = 0.7, z: float = 1.959964) -> DataFrame:
    """Of lag_correlations: |r| above least_r, and p below 0.05 by Fisher's transform (z is that quantile), strongest first."""
    sure = (F.abs("r") >= 1) | (F.abs(F.atanh("r")) * F.sqrt(F.col("n") - 3) > z)
    return lags.filter((F.abs("r") > least_r) & (F.col("n") > 3) & sure).orderBy(F.desc(F.abs("r")), "lag")


def p_value(r: float, n: int) -> float:
    """Two-sided p of a Pearson r over n pairs, by Fisher's transform."""
    from math import atanh, erfc, sqrt

    return 1.0 if n <= 3 else 0.0 if abs(r) >= 1 else erfc(abs(atanh(r)) * sqrt(n - 3) / sqrt(2))


@dataclass
class Report:
    summary: str
    anomalies: list[dict] = field(default_factory=list)
    correlations: list[dict] = field(default_factory=list)
    context: str = ""


def report(df: DataFrame, question: str = "", keys: list[str] = (), most_anomalies: int = 10, most_correlations: int = 5) -> Report:
    """The strongest findings of a result, as text. A top-k report: the limits are the feature."""
    if df.isEmpty():
        return Report(NO_DATA)
    columns = numeric_columns(df)
    odd = [r.asDict() for r in anomalies(df, columns, keys).orderBy(F.desc("z"), "column", *keys).limit(most_anomalies).collect()]
    tied = [r.asDict() for r in correlations(df, columns).orderBy(F.desc(F.abs("r")), "a", "b").limit(most_correlations).collect()]
    lines = [f"Question: {question}"] * bool(question) + [f"Columns: {', '.join(columns) or 'none numeric'}"]
    lines += [f"Anomaly: {x['column']} = {x['value']:g} (z = {x['z']:.2f})" for x in odd] or ["No anomalies."]
    lines += [f"Correlation: {x['a']} with {x['b']} (r = {x['r']:.3f})" for x in tied] or ["No strong correlations."]
    return Report(f"{len(odd)} anomalies and {len(tied)} correlations shown.", odd, tied, "\n".join(lines))
