import glob
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracemill import nl
from tracemill.engine import Engine
from tracemill.operators import joins, rca, ring, windows
from tracemill.plans.parser import parse


def test_join_strategy():
    assert [joins.strategy(*x) for x in ((5, 10**9), (10**6, 10**6), (10**7, 10**6), (None, None), (None, 10_000))] == ["nested_loop", "hash", "sort_merge", "sort_merge", "nested_loop"]


@pytest.mark.parametrize("how", ["inner", "left", "right"])
@pytest.mark.parametrize("rows", [(None, None), (10, 10**7), (10**7, 10), (10**5, 10**5), (10**7, 10**7)])
def test_join_hints_change_no_rows(spark, how, rows):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    assert sorted(map(repr, joins.join(a, b, "k", how, *rows).collect())) == sorted(map(repr, a.join(b, "k", how).collect()))


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 5, 3), ("a", None, 4), (None, 9, 5), ("a", 1, 6)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 7, "z"), ("b", 6, "w"), ("a", None, "n"), (None, 1, "m")], "k string, t long, v string")
    got = {r.id: (r.t_asof, r.v_asof) for r in joins.asof(left, right, ["k"], "t").collect()}
    assert got == {1: (5, "y"), 2: (7, "z"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    assert {r.id: r.v_asof for r in joins.asof(left, right, ["k"], "t", tolerance=2).collect()}[2] is None


def test_only_small_sides_are_broadcast(spark, monkeypatch):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    plan = lambda: joins.join(a, b, "k", "inner", 10**7, 50)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10)
    assert "broadcast" not in plan()


def test_range_join(spark):
    r = random.Random(2)
    points = [(i, r.randrange(-50, 50)) for i in range(80)]
    spans = [(i, a, a + r.randrange(-2, 30)) for i in range(30) for a in [r.randrange(-60, 50)]]
    got = joins.within(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "s int, low long, high long"), "at", "low", "high", 7)
    assert sorted((x.p, x.s) for x in got.collect()) == sorted((p, s) for p, at in points for s, lo, hi in spans if lo <= at <= hi)


@pytest.mark.parametrize("block,known", [(1, False), (3, True), (504, True), (504, False)])
def test_range_join_by_blocks(spark, monkeypatch, tmp_path, block, known):
    """Ties, repeated rows, nulls, empty spans and columns of one name on both sides."""
    monkeypatch.setattr(joins, "BLOCK", block)
    r = random.Random(block)
    points = [(i % 70, r.choice([None, *range(-20, 20)])) for i in range(90)]
    spans = [(i, a, b) for i in range(30) for a, b in [(r.choice([None, *range(-30, 20)]), r.choice([None, *range(-30, 30)]))]]
    p, s = spark.createDataFrame(points, "id int, at long"), spark.createDataFrame(spans, "id int, low long, high long")
    if known:
        p.write.parquet(str(tmp_path / "p"))
        p = spark.read.parquet(str(tmp_path / "p"))
    got = joins.within(p, s, "at", "low", "high", 7)
    assert got.columns == ["id", "at", "id", "low", "high"]
    want = [(i, at, *x) for i, at in points for x in spans if None not in (at, *x) and x[1] <= at <= x[2]]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_range_join_gives_runs_of_a_span(spark, tmp_path):
    """Pairs are ordered so that files hold them in few bytes: a span's points follow each other."""
    points, spans = spark.range(3000).select("id", F.col("id").alias("at")), spark.range(200).select(F.col("id").alias("s"), F.lit(0).alias("low"), F.lit(2999).alias("high"))
    joins.within(points, spans, "at", "low", "high", 3000).select("s", "id").write.parquet(str(tmp_path / "out"))
    found = [pq.read_table(f)["s"].to_pylist() for f in glob.glob(f"{tmp_path}/out/*.parquet")]
    assert sum(map(len, found)) == 600_000
    assert sum(a != b for x in found for a, b in zip(x, x[1:])) < 6000


def test_windows(spark):
    df = spark.createDataFrame([("a", i * 10**9, float(v)) for i, v in enumerate([1, 1, 4, 4])] + [("b", 0, 9.0), ("b", 0, 8.0)], "k string, t long, v double")
    assert [r.z for r in windows.rolling_z(df, "v", ["t"], ["k"], 1).filter("k = 'a'").orderBy("t").collect()] == [None, None, 1.0, None]
    assert [r.change for r in windows.change(df, "v", "t", ["t", "v"], ["k"]).orderBy("k", "t", "v").collect()] == [None, 0.0, 3.0, 0.0, None, None]
    assert [r.session for r in windows.sessions(df, "t", ["t"], ["k"], 10**9 - 1).filter("k = 'a'").orderBy("t").collect()] == [1, 2, 3, 4]
    assert sorted(r.v for r in windows.top_per_group(df, ["k"], [F.desc("v"), "t"], 1).collect()) == [4.0, 9.0]


def test_numeric_columns(spark):
    df = spark.createDataFrame([(1, "2", "x", None, True), (2, "3.5", "4", 1.0, False)], "a int, b string, c string, d double, e boolean")
    assert rca.numeric_columns(df) == ["a", "b", "e"]
    assert rca.numeric_columns(df.limit(0)) == []


def test_anomalies(spark):
    df = spark.createDataFrame([(i, 10.0 + i % 3, "7") for i in range(30)] + [(99, 500.0, "7")], "id int, v double, same string")
    assert [tuple(r) for r in rca.anomalies(df, ["v", "same"], ["id"]).collect()] == [(99, "v", 500.0, 5.48)]
    assert rca.anomalies(df, []).count() == 0


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), -2.0 * i, 5.0, float(i * 7 % 10)) for i in range(10)], "a double, b double, c double, d double")
    assert [tuple(r) for r in rca.correlations(df, ["a", "b", "c", "d"]).collect()] == [("a", "b", -1.0)]
    assert rca.correlations(df.limit(2), ["a", "b"]).count() == 0 and rca.correlations(df, ["a"]).count() == 0


def test_lag_correlations_find_the_lag(spark):
    r = random.Random(1)
    a = [r.random() for _ in range(80)]
    df = spark.createDataFrame([(t, a[t], a[t - 3] if t >= 3 else 0.0) for t in range(80)], "t long, a double, b double")
    rows = {x.lag: x for x in rca.lag_correlations(df, "t", "a", "b", 1, range(-5, 6)).collect()}
    assert max(rows, key=lambda k: rows[k].r) == 3 and rows[3].r > 0.95
    assert [x.lag for x in rca.significant(rca.lag_correlations(df, "t", "a", "b", 1, range(-5, 6))).collect()] == [3]
    assert rca.p_value(rows[3].r, rows[3].n) < 0.001 < 0.05 < rca.p_value(0.05, 80)


def test_report(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)] + [(40, 900.0)], "i int, v double")
    out = rca.report(df, "what broke?")
    assert "v = 900" in out.context and out.anomalies[0]["column"] == "v" and "what broke?" in out.context
    assert rca.report(df.limit(0)).summary == rca.NO_DATA


def test_ring(spark):
    r = ring.Ring([f"n{i}" for i in range(5)])
    keys = [str(i) for i in range(3000)]
    owners = {k: r.locate(k, 3) for k in keys}
    assert all(len(set(o)) == 3 for o in owners.values())
    share = Counter(o[0] for o in owners.values())
    assert all(0.5 < n / 600 < 1.6 for n in share.values())
    fewer = ring.Ring([f"n{i}" for i in range(4)])
    assert all(fewer.locate(k)[0] == o[0] for k, o in owners.items() if o[0] != "n4")
    df = spark.createDataFrame([(k,) for k in keys[:200]] + [(None,)], "k string")
    assert {x.k: x.nodes for x in ring.assign(df, "k", r, 3).collect()} == {k: owners[k] for k in keys[:200]} | {None: None}
    assert ring.Ring(["only"]).locate("x", 3) == ["only"]


@pytest.mark.parametrize("question,table", [("why the errors?", "logs"), ("show CPU latency", "metrics"), ("slow spans", "traces"), ("hello", "logs")])
def test_templates(question, table):
    assert parse(nl.to_query(question)).source.table == table


def test_templates_run(spark):
    from tracemill import schema

    e = Engine(spark, now=lambda: 10**18)
    for name, s in schema.SIGNALS.items():
        e.register(name, spark.createDataFrame([], s))
    for _, q in nl.TEMPLATES:
        assert e.query(q).count() == 0
    g = nl.grammar(e.catalog)
    drawn = {nl.sample(g, seed) for seed in range(300)}
    assert len(drawn) > 280 and any("BETWEEN" in x for x in drawn) and any(" JOIN " in x for x in drawn)
    for text in drawn:
        parse(text)
    assert '"logs" | "metrics" | "traces"' in g and '"duration_ns"' in g and "root ::= select" in g
    import re

    names = set(re.findall(r"^(\w+) ::=", g, re.M))
    used = set(re.findall(r"\b[a-z]+\b", re.sub(r'"[^"]*"|\[[^\]]*\]', "", g)))
    assert used <= names
