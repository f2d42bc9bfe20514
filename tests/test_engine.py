"""What statements give: the language's rules, case by case."""

import pytest

from tracemill.engine import Engine
from tracemill.errors import BindError, QueryError

NOW = 10_000_000_000_000
ROWS = [(1, 10, "a", 5, 1.5), (2, 20, "b", None, 2.5), (3, 30, None, 7, None), (4, 40, "a", 5, 4.0), (5, 50, "c_d", -3, 0.5), (6, 60, "cxd", 9, 8.0)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, now=lambda: NOW)
    t = spark.createDataFrame(ROWS, "id int, ts long, s string, n long, x double")
    e.register("t", t, time="ts", ties=("id",))
    e.register("u", spark.createDataFrame([(1, "one"), (4, "four"), (9, "nine")], "id int, word string"))
    e.register("empty", t.filter("false"), time="ts")
    return e


def run(engine, text, **kw):
    return [tuple(r) for r in engine.query(text, **kw).collect()]


@pytest.mark.parametrize("text,want", [
    # Comparisons widen; text compares with text.
    ("select id from t where n >= 7 order by id", [(3,), (6,)]),
    ("select id from t where x > n order by id", [(5,)]),
    ("select id from t where id = 2.0", [(2,)]),
    ("select id from t where ts >= now() - 10000s and id < 2", [(1,)]),
    # Arithmetic: whole division truncates, other division by zero is null, the rest has the dividend's sign.
    ("select n / 2, n % 2, n * 2 - 1, -n, x / 2 from t where id = 5", [(-1, -1, -7, 3, 0.25)]),
    ("select x / 0, 7 / 2, 7 / 2.0 from t where id = 1", [(None, 3, 3.5)]),
    # Aggregates skip nulls, each on its own; of nothing they are one row.
    ("select count(*), count(n), sum(n), avg(x), min(n), max(x) from t", [(6, 5, 23.0, 3.3, -3, 8.0)]),
    ("select count(*), count(n), sum(n), avg(x), min(n) from empty", [(0, 0, None, None, None)]),
    ("select s, count(*) from empty group by s", []),
    ("select s as k, sum(n), avg(x) from t group by s order by k", [("a", 10.0, 2.75), ("b", None, 2.5), ("c_d", -3.0, 0.5), ("cxd", 9.0, 8.0), (None, 7.0, None)]),
    ("select n % 2 as odd, count(*) c from t where n is not null group by odd order by odd", [(-1, 1), (1, 4)]),
    ("select sum(n) / count(*) from t", [(23 / 6,)]),
    ("select count(*) filter (where n > 5) as big, count(*) as all_ from t having big > 1", [(2, 6)]),
    ("select s from t group by s having count(*) > 1", [("a",)]),
    ("select id from t having id > 5", [(6,)]),
    # Projections, aliases, distinct.
    ("select id + 1 as a, a * 10 b from t where id = 1", [(2, 20)]),
    ("select distinct s from t order by s", [("a",), ("b",), ("c_d",), ("cxd",), (None,)]),
    ("select distinct n, s from t where s = 'a'", [(5, "a")]),
    # Order: nulls last both ways, expressions, hidden columns; limit and offset come last.
    ("select s from t order by s desc, id", [("cxd",), ("c_d",), ("b",), ("a",), ("a",), (None,)]),
    ("select id from t order by n desc, id limit 2 offset 1", [(3,), (1,)]),
    ("select id from t order by -id offset 4", [(2,), (1,)]),
    ("select id from t where n = 5 order by x desc limit 1", [(4,)]),
    ("select id as n from t where id < 3 order by n desc", [(2,), (1,)]),
    ("select s, count(*) from t group by s order by count(*) desc, s limit 1", [("a", 2)]),
    ("select id from t limit 0", []),
    # Three-valued logic.
    ("select id from t where n is null or n = 9 order by id", [(2,), (6,)]),
    ("select id from t where true or n = 1 order by id limit 1", [(1,)]),
    ("select id from t where not (n = 5) order by id", [(3,), (5,), (6,)]),
    ("select id from t where null", []),
    # LIKE, IN, BETWEEN.
    ("select id from t where s like 'c_d' order by id", [(5,), (6,)]),
    ("select id from t where s like '%d' and s not like 'cx%'", [(5,)]),
    ("select 'aba' like '%a', 'a\\b' like 'a\\b' from t limit 1", [(True, True)]),
    ("select id from t where s in ('b', 'zz') or n in (x + 1, 9) order by id", [(2,), (4,), (6,)]),
    ("select id from t where n not in (5, 7)order by id", [(5,), (6,)]),
    ("select id from t where ts between 20 and 30 and ts not between 25 and 35", [(2,)]),
    # Time series.
    ("select time_bucket(25, ts) b, count(*) from t group by b order by b", [(0, 2), (25, 2), (50, 2)]),
    ("select time_bucket('1us', ts) b, rate(n, '2 s'), rate(count(*), 3s), rate(sum(n), interval '1 s') from t group by b", [(0, 2.5, 2.0, 23.0)]),
    ("select delta(n, 1s), delta(x, 1h) from t", [(4, 6.5)]),
    ("select s, delta(n, 1s) d from t where s = 'a' group by s", [("a", 0)]),
    ("select histogram_quantile(0.5, n), histogram_quantile(0, n), histogram_quantile(1.0, n, 50), count(*) from t", [(5, -3, 9, 6)]),
    ("select s, histogram_quantile(0.5, n) q from t group by s order by s", [("a", 5), ("b", None), ("c_d", -3), ("cxd", 9), (None, 7)]),
    ("select histogram_quantile(0.5, n) filter (where n > 5) q from t", [(9,)]),
    ("select histogram_quantile(0.5, n) from empty", [(None,)]),
    ("select now(), interval '1 h' - 1m from t limit 1", [(NOW, 59 * 60 * 10**9)]),
    ("select percentile(n, 0.5), round(stddev(n), 3), count_distinct(n), approx_count_distinct(s) from t", [(5.0, 4.561, 4, 4)]),
    ("select round(x, 0), upper(s), coalesce(n, 0), length(s) from t where id = 2", [(3.0, "B", 0, 1)]),
    # Joins.
    ("select t.id, u.word from t join u on t.id = u.id order by t.id", [(1, "one"), (4, "four")]),
    ("select a.id, word from t a left join u b on a.id = b.id and a.id > 1 where a.id in (1, 4) order by a.id", [(1, None), (4, "four")]),
    ("select b.id, a.s from t a right join u b on a.id = b.id order by b.id", [(1, "a"), (4, "a"), (9, None)]),
    ("select a.id, b.id from t a join t b on a.id < b.id and a.n = b.n", [(1, 4)]),
    ("select a.id, c.word from t a join t b on a.n = b.n left join u c on c.id = b.id where a.id = 1 order by c.word", [(1, "four"), (1, "one")]),
    ("select * from u a join u b on a.id = b.id where a.id = 9", [(9, "nine", 9, "nine")]),
])
def test_results(engine, text, want):
    assert run(engine, text) == want


@pytest.mark.parametrize("text", [
    "select * from nowhere", "select y from t", "select t.y from t", "select z.id from t", "select id from t join u on t.id = u.id", "select id from t order by y", "select s, count(*) from t", "select s, n from t group by s",
    "select id from t where count(*) > 1", "select count(*) from t group by count(*)", "select foo(id) from t", "select sum(*) from t", "select count() from t", "select sum(count(*)) from t", "select lower(*) from t", "select lower(s, s) from t",
    "select lower(s) filter (where id > 1) from t", "select time_bucket(0, ts) from t", "select time_bucket(n, ts) from t", "select rate(n, 0) from t", "select histogram_quantile(1.1, n) from t", "select histogram_quantile(n, n) from t", "select delta(id, 1s) from u",
    "select distinct s from t order by id", "select a.id from t a join u a on true", "select * from t group by s",
])
def test_bind_errors(engine, text):
    with pytest.raises(BindError):
        engine.query(text)


def test_errors_are_of_one_family(engine):
    for text in ("select '", "select", "select y from t", "select time_bucket('1 x', ts) from t"):
        with pytest.raises(QueryError):
            engine.query(text)


def test_names_of_columns(engine):
    assert engine.query('select s, count(*), n + 1, id as "the id", x y from t group by s, n, id, x').columns == ["s", "count(*)", "n + 1", "the id", "y"]


def test_whole_division_by_zero_is_an_error(engine):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run(engine, "select n / 0 from t")


@pytest.mark.parametrize("hint,node", [("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_join_hints(engine, hint, node):
    df = engine.query("select t.id from t join u on t.id = u.id", join_hint=hint)
    assert node in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in df.collect()) == [(1,), (4,)]


def test_pushdown_and_pruning_of_columns(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, ts long, s string, n long, x double").write.parquet(str(tmp_path / "t"))
    e = Engine(spark).register("t", spark.read.parquet(str(tmp_path / "t")), time="ts")
    plan = e.query("select a.id, count(*) c from t a join t b on a.id = b.id where a.n >= 5 and b.s = 'a' group by a.id order by c desc limit 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,5)" in plan and "EqualTo(s,a)" in plan and "TakeOrderedAndProject" in plan
    assert "x:double" not in plan and "ts:bigint" not in plan


def test_unsigned_columns_become_bigint(spark):
    df = spark.createDataFrame([(1,)], "a int").selectExpr("cast(a as decimal(20,0)) as a")
    assert dict(Engine(spark).register("d", df).query("select a / 1 as b from d").dtypes) == {"b": "bigint"}


def test_functions_of_ones_own(engine, spark):
    from pyspark.sql import functions as F

    own = Engine(spark).register("t", spark.createDataFrame(ROWS, "id int, ts long, s string, n long, x double")).function("twice", lambda x: x * 2).function("tag", lambda x, sep="-": F.concat(x, F.lit(sep)), 1, 2)
    assert run(own, "select twice(n), TAG(s, '!'), tag(s) from t where id = 1") == [(10, "a!", "a-")]
    with pytest.raises(BindError):
        engine.query("select twice(n) from t")


def test_convenience_columns(spark):
    e = Engine(spark)
    e.register("logs", spark.createDataFrame([(1, '{"service.name":"api"}')], "timestamp_ns long, resource_attributes string"))
    e.register("metrics", spark.createDataFrame([(1, "cpu", None, 3)], "timestamp_ns long, name string, value_double double, value_int long"))
    e.register("traces", spark.createDataFrame([(7, 2)], "start_time_ns long, duration_ns long"))
    assert run(e, "select service_name from logs") == [("api",)]
    assert run(e, "select metric_name, value from metrics") == [("cpu", 3.0)]
    assert run(e, "select timestamp_ns from traces") == [(7,)]


@pytest.mark.parametrize("text", [
    "select id from t where row_number() over (order by id) = 1", "select id from t group by rank() over (order by id)", "select row_number() over () from t", "select lower(s) over (order by id) from t", "select ntile(x) over (order by id) from t",
    "select percentile(n, 0.5) over (order by id) from t", "select cast(id as blob) from t", "select id from t union select id, n from t", "select id from t join u using (none)", "select u.id from t semi join u on t.id = u.id",
    "select histogram_quantile(0.5, n) from t group by cube (s)", "select a.id from (select id from t) a join (select id from t) a on a.id = a.id", "select x from (select id from t) a", "with a as (select id from t) select n from a",
])
def test_statements_that_bind_to_nothing(engine, text):
    with pytest.raises(BindError):
        engine.query(text)


@pytest.mark.parametrize("text", [
    "select case when id = 1 then 2 from t", "select case end from t", "select case when id then 1 else 2 from t", "select id from (select id from t)", "select id from t cross join u on t.id = u.id", "select sum(n) over (rows between 1 and 2) from t",
    "select id from t union", "select id from t limit 1 union select id from t", "with a as select id from t select id from a", "select cast(id) from t",
])
def test_statements_that_are_none(engine, text):
    with pytest.raises(QueryError):
        engine.query(text)


def test_words_of_later_syntax_stay_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], '`union` int, `case` int, `over` int, `full` int, `with` int, `end` int')
    e = Engine(spark).register("t", df)
    assert run(e, "select union, case, over, full, with, t.end from t where case + 1 = 3 and over > 1") == [(1, 2, 3, 4, 5, 6)]
    assert run(e, "select a.case as case, 7 as union from t as a") == [(2, 7)]


def test_nested_statements_prune_and_push_down(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, ts long, s string, n long, x double").write.parquet(str(tmp_path / "t"))
    e = Engine(spark).register("t", spark.read.parquet(str(tmp_path / "t")), time="ts")
    plan = e.query("with big as (select id, n, x from t where n >= 2) select id from (select id, n from big) b where n < 9 union all select id from big where id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,2)" in plan and "LessThan(n,9)" in plan and "x:double" not in plan
