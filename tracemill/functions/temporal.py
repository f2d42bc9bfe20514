"""Time-series functions as columns and as group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sizes import estimated_bytes

SECOND = 10**9
#: Parts that the values of a group are ranked in if it has more than LARGE distinct ones.
BINS, LARGE = 64, 1_000_000
#: Estimated size of an input up to which its groups are ranked without bins: none can be large.
SMALL_BYTES = 32 << 20


def time_bucket(width_ns: int, ts: Column) -> Column:
    """The start of ts's bucket: ts rounded down to a multiple of width_ns."""
    if width_ns <= 0:
        raise ValueError(f"bucket width {width_ns} is not positive")
    return ts - F.pmod(ts, F.lit(width_ns))


def per_second(count: Column, window_ns: int) -> Column:
    if window_ns <= 0:
        raise ValueError(f"window {window_ns} is not positive")
    return count / F.lit(window_ns / SECOND)


def delta(x: Column, order: Column) -> Column:
    """Last minus first x by order, among rows where x is not null."""
    key = F.when(x.isNotNull(), order)
    return F.max_by(x, key) - F.min_by(x, key)


def nearest_rank(df: DataFrame, keys: list[str], x: str, q: float, out: str) -> DataFrame:
    """(keys, out): the value of rank round_half_up(q * (n - 1)) of each group's non-null x, counted from 0."""
    return quantiles(df, keys, x, [(q, out, False)])


def interpolated(df: DataFrame, keys: list[str], x: str, q: float, out: str) -> DataFrame:
    """(keys, out): the value at q * (n - 1) of each group's sorted non-null x, linear between two of them."""
    return quantiles(df, keys, x, [(q, out, True)])


def quantiles(df: DataFrame, keys: list[str], x: str, asked: list[tuple[float, str, bool]]) -> DataFrame:
    """keys and a column for each (q, its name, whether between two values), of each group with a non-null x.

    Exact at any size, and no task sorts all of a large group.  Equal values are
    counted before anything moves.  The values of large groups are put into bins
    by approximate quantiles of them; the bins' counts tell which bins hold the
    ranks that are asked for, and only these are sorted.  Bins' borders don't
    show in the result.
    """
    for q, _, _ in asked:
        if not 0 <= q <= 1:
            raise ValueError(f"quantile {q} is not in 0..1")
    names = [f"__q{i}" for i in range(len(keys))]
    by = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    counted = df.filter(F.col(f"`{x}`").isNotNull()).groupBy(*by, F.col(f"`{x}`").alias("__x")).agg(F.count("*").alias("__n"))
    if estimated_bytes(df) <= SMALL_BYTES:
        group = Window.partitionBy(*(names or [F.lit(1)]))
        upto = F.sum("__n").over(group.orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
        return _picked(counted.withColumns({"__upto": upto, "__all": F.sum("__n").over(group)}), keys, names, asked)
    edges = counted.groupBy(*names).agg(F.count("*").alias("__many"), F.percentile_approx(F.col("__x").cast("double"), [i / BINS for i in range(1, BINS)], 100 * BINS).alias("__edges")).filter(F.col("__many") > LARGE)
    binned = _joined(counted, edges.select(*names, "__edges"), names, "left")
    binned = binned.withColumn("__bin", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col("__x").cast("double"))), F.lit(0))).drop("__edges")
    group = Window.partitionBy(*(names or [F.lit(1)]))  # of BINS rows
    sums = binned.groupBy(*names, "__bin").agg(F.sum("__n").alias("__here"))
    sums = sums.withColumns({"__before": F.sum("__here").over(group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__here"), "__all": F.sum("__here").over(group)})
    hit = F.lit(False)
    for q, _, between in asked:
        _, low, high = _ranks(q, between)
        hit = hit | ((F.col("__before") <= high) & (F.col("__before") + F.col("__here") > low))
    inside = F.sum("__n").over(Window.partitionBy(*names, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = _joined(binned, sums.filter(hit).drop("__here"), [*names, "__bin"], "inner").withColumn("__upto", F.col("__before") + inside)
    return _picked(ranked, keys, names, asked)


def _ranks(q: float, between: bool) -> tuple[Column, Column, Column]:
    """(place, the ranks below and above it) of a quantile among __all values."""
    place = F.lit(float(q)) * (F.col("__all") - 1)
    return (place, F.floor(place), F.ceil(place)) if between else (place, *(F.floor(place + 0.5),) * 2)


def _picked(ranked: DataFrame, keys: list[str], names: list[str], asked: list[tuple[float, str, bool]]) -> DataFrame:
    """The quantiles from rows that say which ranks they hold: __n of them, up to __upto."""
    at = lambda rank: F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank), F.col("__x")))
    ranks = [_ranks(q, between) for q, _, between in asked]
    ends = ranked.groupBy(*names).agg(*[c for i, (place, low, high) in enumerate(ranks) for c in (at(low).alias(f"__a{i}"), at(high).alias(f"__b{i}"), F.max(place - low).alias(f"__share{i}"))])
    made = [((F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__share{i}")) if between else F.col(f"__a{i}")).alias(out) for i, (_, out, between) in enumerate(asked)]
    # Without keys an aggregate of no rows is a row.
    return ends.filter(F.col("__a0").isNotNull()).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *made)


def _joined(a: DataFrame, b: DataFrame, names: list[str], how: str) -> DataFrame:
    """a with b by names, in which null equals null; each once."""
    right = b.withColumnsRenamed({n: f"{n}_r" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_r"))
    return a.join(right if names else F.broadcast(right), on, how).drop(*[f"{n}_r" for n in names])


def bucket_quantile(q: float, bounds: Column, counts: Column) -> Column:
    """Quantile of a stored histogram: linear within the bucket that holds it; the last bucket gives its lower bound.

    bounds are n upper bounds, counts n + 1 bucket counts. Null for an empty histogram.
    """
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is not in 0..1")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    rank = F.lit(float(q)) * total
    before = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda i: F.aggregate(F.slice(counts, 1, i - 1), F.lit(0).cast("long"), lambda a, c: a + c))
    at = F.array_position(F.transform(F.arrays_zip(before.alias("b"), counts.alias("c")), lambda z: (z["b"] + z["c"] >= rank) & (z["c"] > 0)), True).cast("int")
    low = F.when(at > 1, F.element_at(bounds, at - 1)).otherwise(F.least(F.lit(0.0), F.element_at(bounds, 1)))
    high = F.element_at(bounds, F.least(at, F.size(bounds)))
    share = (rank - F.element_at(before, at)) / F.element_at(counts, at)
    return F.when((total > 0) & (F.size(bounds) > 0), F.when(at > F.size(bounds), F.element_at(bounds, -1)).otherwise(low + (high - low) * share))
