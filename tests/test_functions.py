import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.engine import Engine
from tracemill.functions import temporal
from tracemill.functions.scalars import SCALARS
from tracemill.schema import severity_name


def test_time_bucket(spark):
    df = spark.createDataFrame([(0,), (60 * 10**9,), (90 * 10**9,), (120 * 10**9,), (None,)], "t long")
    assert [r[0] for r in df.select(temporal.time_bucket(60 * 10**9, F.col("t"))).collect()] == [0, 60 * 10**9, 60 * 10**9, 120 * 10**9, None]
    with pytest.raises(ValueError):
        temporal.time_bucket(0, F.lit(1))


@pytest.mark.parametrize("values,q,want", [([1, 2, 3, 4, 5], 0.5, 3), ([9, 13, 17, 21], 0.5, 17), ([4], 0.99, 4), ([1, 1, 1, 9], 0.5, 1), ([3, 1, 2], 1, 3), ([None, 5, None], 0.5, 5)])
def test_nearest_rank(spark, values, q, want):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
    assert temporal.nearest_rank(df, ["k"], "v", q, "out").collect() == [("k", want)]
    assert temporal.nearest_rank(df, [], "v", q, "out").collect() == [(want,)]


def test_nearest_rank_against_sorted_lists(spark):
    import random

    r = random.Random(4)
    rows = [(r.randrange(6) or None, r.choice([None, *range(12)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = {x.k: x.out for x in temporal.nearest_rank(df, ["k"], "v", q, "out").collect()}
        for k in {k for k, _ in rows}:
            s = sorted(v for a, v in rows if a == k and v is not None)
            assert got[k] == s[int(q * (len(s) - 1) + 0.5)]


def test_ungrouped_rank_in_bins(spark):
    import random

    r = random.Random(6)
    values = [r.choice([-5, 0, 3, 10**6, *range(700)]) * r.choice([1, 1, 0.5]) for _ in range(1500)] + [7] * 900
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    for q in (0.0, 0.01, 0.5, 0.77, 1.0):
        assert temporal.nearest_rank(df, [], "v", q, "out").first()[0] == sorted(values)[int(q * (len(values) - 1) + 0.5)]
    assert temporal.nearest_rank(df.filter("v is null"), [], "v", 0.5, "out").collect() == []


@pytest.mark.parametrize("bounds,counts,q,want", [
    ([10.0, 20.0], [4, 4, 0], 0.5, 10.0), ([10.0, 20.0], [0, 10, 0], 0.5, 15.0), ([10.0, 20.0], [0, 0, 3], 0.5, 20.0), ([10.0, 20.0], [0, 0, 0], 0.5, None), ([10.0], [2, 2], 0.25, 5.0), ([], [3], 0.5, None),
])
def test_bucket_quantile(spark, bounds, counts, q, want):
    df = spark.createDataFrame([(bounds, counts)], "b array<double>, c array<long>")
    assert df.select(temporal.bucket_quantile(q, F.col("b"), F.col("c"))).first()[0] == want


def test_severities(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 4, 5, 9, 13, 17, 20, 24, 25)], "n int")
    assert [r[0] for r in df.select(severity_name(F.col("n"))).collect()] == ["UNSPECIFIED", "TRACE", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "ERROR", "FATAL", "UNSPECIFIED"]


@pytest.mark.parametrize("large", [10**6, 20, None])
@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_grouped_quantiles_of_large_and_small_groups(spark, monkeypatch, large, q):
    """Groups of one value to thousands, null keys and values, ties: with bins and without."""
    import random

    from tracemill.functions import temporal

    monkeypatch.setattr(temporal, "LARGE", large or 1)
    monkeypatch.setattr(temporal, "SMALL_BYTES", 0 if large else 1 << 99)
    r = random.Random(7)
    rows = [(k, r.choice([None, float(r.randrange(40)), r.gauss(0, 50)])) for k, n in (("a", 3000), ("b", 300), ("c", 1), (None, 500)) for _ in range(n)] + [("d", None), ("e", 2.5)]
    df = spark.createDataFrame(rows, "k string, x double")
    near = {x.k: x.v for x in temporal.nearest_rank(df, ["k"], "x", q, "v").collect()}
    linear = {x.k: x.v for x in temporal.interpolated(df, ["k"], "x", q, "v").collect()}
    want = {}
    for k, x in rows:
        if x is not None:
            want.setdefault(k, []).append(x)
    assert near.keys() == linear.keys() == want.keys()
    import numpy as np

    for k, xs in want.items():
        xs.sort()
        assert near[k] == xs[int(q * (len(xs) - 1) + 0.5)]
        assert linear[k] == pytest.approx(float(np.quantile(xs, q)), abs=1e-9)
    assert temporal.nearest_rank(df, [], "x", q, "v").first().v == sorted(x for _, x in rows if x is not None)[int(q * (sum(x is not None for _, x in rows) - 1) + 0.5)]


def test_logarithms_of_no_positive_numbers(spark):
    """ln as DuckDB has it, of zeros and of whole numbers too."""
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (-0.0, 0), (-2.0, -2), (math.inf, 1), (math.nan, 1), (None, None)], "x double, n long")
    ln = SCALARS["ln"][2]
    got = [[r.a, r.b] for r in df.select(ln(F.col("x")).alias("a"), ln(F.col("n")).alias("b")).collect()]
    want = [[0.0, 0.0], [-math.inf, -math.inf], [-math.inf, -math.inf], [math.nan, math.nan], [math.inf, 0.0], [math.nan, 0.0], [None, None]]
    assert repr(got) == repr(want)


def test_statement_with_logarithms_against_duckdb(spark):
    """Rows that sf0.001 has none of: value 0, as in sf0.1."""
    rows = [(k, v) for k, v in enumerate([0.0, 0.5, 1.0, 250.0])]
    e = Engine(spark).register("t", spark.createDataFrame(rows, "event_id int, value double"), time="event_id")
    want = duckdb.sql("SELECT event_id, round(ln(value), 8) AS l FROM (VALUES (0, 0.0::DOUBLE), (1, 0.5), (2, 1.0), (3, 250.0)) t(event_id, value)").fetchall()
    assert sorted(tuple(r) for r in e.query("SELECT event_id, round(ln(value), 8) AS l FROM t").collect()) == sorted(want)
