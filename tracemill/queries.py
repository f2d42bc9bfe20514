"""Queries over the test tables, each with the SQL that DuckDB answers alike.

events stand for logs and metrics, lineitem for traces.  Queries in the query
language go through the engine; operators without syntax are called directly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import io_queries
from tracemill.functions import temporal
from tracemill.inputs import DAY, HOUR, M, NOW, T0, T1, WITH, engine, metric_rows, read
from tracemill.operators import joins, rca, ring, windows
from tracemill.plans import syntax as s
from tracemill.plans.parser import parse

#: name: (statement of the query language, SQL after WITH).
STATEMENTS: dict[str, tuple[str, str]] = {
    "errors_by_bucket": (
        "SELECT time_bucket('1 hour', timestamp_ns) AS bucket, count(*) AS n, round(rate(count(*), '1 hour'), 9) AS per_second FROM logs WHERE severity_number >= 17 GROUP BY bucket ORDER BY bucket",
        f"SELECT timestamp_ns // {HOUR} * {HOUR} AS bucket, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM logs WHERE severity_number >= 17 GROUP BY 1"),
    "log_search": (
        f"SELECT timestamp_ns, event_id, body, severity_number FROM logs WHERE severity_number >= 13 AND timestamp_ns BETWEEN {T0} AND {T1} ORDER BY timestamp_ns, event_id LIMIT 200",
        f"SELECT timestamp_ns, event_id, body, severity_number FROM logs WHERE severity_number >= 13 AND timestamp_ns BETWEEN {T0} AND {T1} ORDER BY timestamp_ns, event_id LIMIT 200"),
    "scan_logs": ("SELECT * FROM logs", "SELECT * FROM logs"),
    "scan_metrics": ("SELECT timestamp_ns, metric_name, value FROM metrics", "SELECT timestamp_ns, metric_name, value FROM metrics"),
    "scan_traces": ("SELECT t.trace_id, t.span_id, t.timestamp_ns, t.duration_ns FROM traces AS t", "SELECT trace_id, span_id, timestamp_ns, duration_ns FROM traces"),
    "filter_comparisons": (
        "SELECT event_id, value FROM metrics WHERE (value > 10 AND value <= 20.5) OR value < 0.5 OR NOT (user_id <> 7 OR value >= 400.0) OR (user_id != 3 AND value = 77)",
        "SELECT event_id, value FROM metrics WHERE (value > 10 AND value <= 20.5) OR value < 0.5 OR NOT (user_id <> 7 OR value >= 400.0) OR (user_id <> 3 AND value = 77)"),
    "kleene_logic": (
        "SELECT event_id FROM logs WHERE severity_text = 'error' OR severity_text IS NULL OR NOT severity_text LIKE 'v%'",
        "SELECT event_id FROM logs WHERE severity_text = 'error' OR severity_text IS NULL OR NOT severity_text LIKE 'v%'"),
    "between_in_like": (
        "SELECT event_id, body FROM logs WHERE user_id BETWEEN 5 AND 40 AND user_id NOT BETWEEN 10 AND 12 AND body IN ('view', 'click', 'error') AND user_id NOT IN (20, 21) AND body LIKE '%_i%' AND body NOT LIKE 'x%'",
        "SELECT event_id, body FROM logs WHERE user_id BETWEEN 5 AND 40 AND user_id NOT BETWEEN 10 AND 12 AND body IN ('view', 'click', 'error') AND user_id NOT IN (20, 21) AND body LIKE '%_i%' AND body NOT LIKE 'x%'"),
    "null_tests": (
        "SELECT severity_text IS NULL AS missing, count(*) AS n, count(severity_text) AS present FROM logs WHERE body IS NOT NULL GROUP BY missing",
        "SELECT severity_text IS NULL AS missing, count(*) AS n, count(severity_text) AS present FROM logs WHERE body IS NOT NULL GROUP BY 1"),
    "arithmetic": (
        "SELECT trace_id, span_id, duration_ns / 1000000 AS ms, duration_ns % 7 AS rest, -span_id AS minus, (trace_id + span_id) * 2 - 1 AS sum2, round(price / 3, 4) AS third FROM traces",
        "SELECT trace_id, span_id, duration_ns // 1000000 AS ms, duration_ns % 7 AS rest, -span_id AS minus, (trace_id + span_id) * 2 - 1 AS sum2, round(price / 3, 4) AS third FROM traces"),
    "literals": (
        "SELECT event_id, 1 AS one, 2.5 AS half, 'it''s' AS text, TRUE AS yes, FALSE AS no, INTERVAL '5 minutes' AS five, now() - 1h AS before FROM logs -- a comment\n;",
        f"SELECT event_id, 1 AS one, 2.5::DOUBLE AS half, 'it''s' AS text, TRUE AS yes, FALSE AS no, 300000000000 AS five, {NOW - HOUR} AS before FROM logs"),
    "bare_durations": (
        "SELECT count(*) AS n FROM logs WHERE timestamp_ns >= now() - 7d AND timestamp_ns < now() - INTERVAL '2 days'",
        f"SELECT count(*) AS n FROM logs WHERE timestamp_ns >= {NOW - 7 * DAY} AND timestamp_ns < {NOW - 2 * DAY}"),
    "aliases": (
        'SELECT l.event_id "the id", l.user_id AS u, u * 2 AS twice, twice + 1 AS more FROM logs l',
        'SELECT event_id AS "the id", user_id AS u, user_id * 2 AS twice, user_id * 2 + 1 AS more FROM logs'),
    "distinct": ("SELECT DISTINCT body, severity_number FROM logs ORDER BY body", "SELECT DISTINCT body, severity_number FROM logs"),
    "global_aggregates": (
        "SELECT count(*) AS n, count(severity_text) AS texts, sum(user_id) AS total, round(avg(user_id), 6) AS mean, min(user_id) AS least, max(user_id) AS most FROM logs",
        "SELECT count(*) AS n, count(severity_text) AS texts, sum(user_id)::DOUBLE AS total, round(avg(user_id), 6) AS mean, min(user_id) AS least, max(user_id) AS most FROM logs"),
    "empty_aggregates": (
        "SELECT count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least FROM metrics WHERE value < 0",
        "SELECT count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least FROM metrics WHERE value < 0"),
    "group_by_keys": (
        "SELECT time_bucket(1d, timestamp_ns) AS day, name, count(*) AS n, round(sum(value), 4) AS total, round(max(value) - min(value), 4) AS spread FROM metrics GROUP BY day, name ORDER BY day, name",
        f"SELECT timestamp_ns // {DAY} * {DAY} AS day, name, count(*) AS n, round(sum(value), 4) AS total, round(max(value) - min(value), 4) AS spread FROM metrics GROUP BY 1, 2"),
    "group_by_expression": (
        "SELECT user_id % 10 AS digit, round(sum(value) / count(*), 6) AS mean FROM metrics GROUP BY user_id % 10",
        "SELECT user_id % 10 AS digit, round(sum(value) / count(*), 6) AS mean FROM metrics GROUP BY 1"),
    "filter_having": (
        "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE severity_number >= 17) AS errors, round(errors * 100.0 / total, 6) AS share FROM logs GROUP BY user_id HAVING errors > 2 AND count(*) < 1000000",
        "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE severity_number >= 17) AS errors, round(count(*) FILTER (WHERE severity_number >= 17) * 100.0::DOUBLE / count(*), 6) AS share FROM logs GROUP BY user_id HAVING count(*) FILTER (WHERE severity_number >= 17) > 2"),
    "statistics": (
        "SELECT name, round(percentile(value, 0.95), 6) AS p95, round(stddev(value), 6) AS sd, count_distinct(user_id) AS users FROM metrics GROUP BY name",
        "SELECT name, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS sd, count(DISTINCT user_id) AS users FROM metrics GROUP BY name"),
    "rate": (
        "SELECT body, round(rate(body, '1 minute'), 6) AS per_second, round(rate(count(*), INTERVAL '1 h'), 9) AS whole FROM logs GROUP BY body",
        "SELECT body, round(count(body) / 60.0::DOUBLE, 6) AS per_second, round(count(*) / 3600.0::DOUBLE, 9) AS whole FROM logs GROUP BY body"),
    "delta": (
        "SELECT name, round(delta(value, '1 day'), 6) AS d FROM metrics GROUP BY name",
        "SELECT name, round(arg_max(value, (timestamp_ns, event_id)) - arg_min(value, (timestamp_ns, event_id)), 6) AS d FROM metrics GROUP BY name"),
    "histogram_quantile": (
        "SELECT name, histogram_quantile(0.95, value) AS p95, histogram_quantile(0.5, value, 50) AS p50, count(*) AS n FROM metrics GROUP BY name",
        "SELECT name, v[floor(0.95 * (n - 1) + 0.5)::BIGINT + 1] AS p95, v[floor(0.5 * (n - 1) + 0.5)::BIGINT + 1] AS p50, n FROM (SELECT name, list(value ORDER BY value) AS v, count(*) AS n FROM metrics GROUP BY name)"),
    "quantile_of_all": (
        "SELECT histogram_quantile(0.99, value) AS p99, histogram_quantile(0.25, user_id) AS p25, count(*) AS n FROM metrics",
        "SELECT v[floor(0.99 * (n - 1) + 0.5)::BIGINT + 1] AS p99, u[floor(0.25 * (n - 1) + 0.5)::BIGINT + 1] AS p25, n FROM (SELECT list(value ORDER BY value) AS v, list(user_id ORDER BY user_id) AS u, count(*) AS n FROM metrics)"),
    "order_nulls_last": (
        "SELECT event_id, severity_text FROM logs ORDER BY severity_text DESC, event_id",
        "SELECT event_id, severity_text FROM logs ORDER BY severity_text DESC NULLS LAST, event_id"),
    "top_k": (
        "SELECT event_id, value FROM metrics ORDER BY value DESC, event_id LIMIT 10 OFFSET 5",
        "SELECT event_id, value FROM metrics ORDER BY value DESC, event_id LIMIT 10 OFFSET 5"),
    "offset_alone": (
        "SELECT event_id FROM logs ORDER BY event_id OFFSET 4",
        "SELECT event_id FROM logs ORDER BY event_id OFFSET 4"),
    "order_by_expression": (
        "SELECT event_id FROM logs ORDER BY user_id % 5 DESC, event_id",
        "SELECT event_id FROM logs ORDER BY user_id % 5 DESC, event_id"),
    "join_inner": (
        "SELECT o.o_orderpriority AS priority, count(*) AS n, sum(t.duration_ns) AS total FROM traces t JOIN orders o ON t.trace_id = o.o_orderkey WHERE t.name = 'R' GROUP BY o.o_orderpriority",
        "SELECT o_orderpriority AS priority, count(*) AS n, sum(duration_ns)::DOUBLE AS total FROM traces JOIN orders ON trace_id = o_orderkey WHERE name = 'R' GROUP BY 1"),
    "join_left": (
        "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey"),
    "join_right": (
        "SELECT c.c_name, o.o_custkey, count(*) AS n FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_name, o.o_custkey",
        "SELECT c_name, o_custkey, count(*) AS n FROM orders RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"),
    "join_chain": (
        "SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT OUTER JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
        "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "join_theta": (
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey OR a.n_nationkey + 20 < b.n_nationkey",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey OR a.n_nationkey + 20 < b.n_nationkey"),
    "cross_signal": (
        "SELECT l.event_id, t.span_id, t.duration_ns FROM logs l JOIN traces t ON l.user_id = t.trace_id WHERE l.severity_number >= 17 AND t.duration_ns > 40000000",
        "SELECT event_id, span_id, duration_ns FROM logs JOIN traces ON user_id = trace_id WHERE severity_number >= 17 AND duration_ns > 40000000"),
    "join_full": (
        "SELECT c.c_custkey AS customer, o.o_orderkey AS placed FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' AND c.c_acctbal > 0",
        "SELECT c_custkey AS customer, o_orderkey AS placed FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND c_acctbal > 0"),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_semi_anti": (
        "SELECT c_custkey, 'with' AS kind FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey UNION ALL SELECT c_custkey, 'without' FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey",
        "SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "join_using": (
        "SELECT user_id, errors, total FROM (SELECT user_id, count(*) AS errors FROM logs WHERE severity_number >= 17 GROUP BY user_id) e FULL JOIN (SELECT user_id, count(*) AS total FROM metrics WHERE value > 100 GROUP BY user_id) t USING (user_id)",
        "SELECT user_id, errors, total FROM (SELECT user_id, count(*) AS errors FROM logs WHERE severity_number >= 17 GROUP BY user_id) e FULL JOIN (SELECT user_id, count(*) AS total FROM metrics WHERE value > 100 GROUP BY user_id) t USING (user_id)"),
    "set_statements": (
        "SELECT user_id FROM metrics WHERE value > 100 UNION SELECT user_id FROM logs WHERE severity_number >= 17 EXCEPT SELECT user_id FROM logs WHERE user_id % 7 = 0 INTERSECT SELECT user_id FROM metrics ORDER BY user_id",
        "SELECT user_id FROM metrics WHERE value > 100 UNION SELECT user_id FROM logs WHERE severity_number >= 17 EXCEPT SELECT user_id FROM logs WHERE user_id % 7 = 0 INTERSECT SELECT user_id FROM metrics"),
    "set_all": (
        "(SELECT user_id FROM metrics EXCEPT ALL SELECT user_id FROM logs WHERE severity_number >= 17) UNION ALL SELECT user_id FROM metrics INTERSECT ALL SELECT user_id FROM logs WHERE user_id < 50",
        "(SELECT user_id FROM metrics EXCEPT ALL SELECT user_id FROM logs WHERE severity_number >= 17) UNION ALL (SELECT user_id FROM metrics INTERSECT ALL SELECT user_id FROM logs WHERE user_id < 50)"),
    "windows": (
        "SELECT event_id, row_number() OVER (PARTITION BY name ORDER BY value DESC, event_id) AS place, rank() OVER (PARTITION BY user_id ORDER BY name) AS ranked, lag(value, 2) OVER (PARTITION BY user_id ORDER BY timestamp_ns, event_id) AS before, round(sum(value) OVER (PARTITION BY name ORDER BY timestamp_ns, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS around, count(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id) AS large FROM metrics",
        "SELECT event_id, row_number() OVER (PARTITION BY name ORDER BY value DESC, event_id) AS place, rank() OVER (PARTITION BY user_id ORDER BY name) AS ranked, lag(value, 2) OVER (PARTITION BY user_id ORDER BY timestamp_ns, event_id) AS before, round(sum(value) OVER (PARTITION BY name ORDER BY timestamp_ns, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS around, count(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id) AS large FROM metrics"),
    "windows_of_groups": (
        "SELECT name, user_id, count(*) AS n, dense_rank() OVER (PARTITION BY name ORDER BY count(*) DESC) AS place, sum(count(*)) OVER (PARTITION BY name) AS total FROM metrics GROUP BY name, user_id",
        "SELECT name, user_id, count(*) AS n, dense_rank() OVER (PARTITION BY name ORDER BY count(*) DESC) AS place, (sum(count(*)) OVER (PARTITION BY name))::DOUBLE AS total FROM metrics GROUP BY name, user_id"),
    "grouping_sets": (
        "SELECT name, user_id % 3 AS third, count(*) AS n FROM metrics GROUP BY GROUPING SETS ((name, user_id % 3), (name), ())",
        "SELECT name, user_id % 3 AS third, count(*) AS n FROM metrics GROUP BY GROUPING SETS ((name, user_id % 3), (name), ())"),
    "cube_rollup": (
        "SELECT 'cube' AS kind, name, status, count(*) AS n FROM traces GROUP BY CUBE (name, status) UNION ALL SELECT 'rollup', name, status, count(*) FROM traces GROUP BY ROLLUP (name, status)",
        "SELECT 'cube' AS kind, name, status, count(*) AS n FROM traces GROUP BY CUBE (name, status) UNION ALL SELECT 'rollup', name, status, count(*) FROM traces GROUP BY ROLLUP (name, status)"),
    "case_cast_concat": (
        "SELECT event_id, CASE WHEN value > 100 THEN 'large' WHEN value > 10 THEN 'middle' ELSE 'small' END AS size, CASE name WHEN 'error' THEN 1 WHEN 'click' THEN 2 END AS code, CAST(event_id AS varchar) || '-' || name AS label, CAST(user_id AS double) / 4 AS part, CAST(name AS int) AS none FROM metrics",
        "SELECT event_id, CASE WHEN value > 100 THEN 'large' WHEN value > 10 THEN 'middle' ELSE 'small' END AS size, CASE name WHEN 'error' THEN 1 WHEN 'click' THEN 2 END AS code, CAST(event_id AS varchar) || '-' || name AS label, CAST(user_id AS double) / 4 AS part, TRY_CAST(name AS int) AS none FROM metrics"),
    "named_statements": (
        "WITH days AS (SELECT time_bucket(1d, timestamp_ns) AS day, count(*) AS n FROM logs GROUP BY day), busy AS (SELECT day, n FROM days WHERE n > 10) SELECT b.day, b.n, e.errors FROM busy b LEFT JOIN (SELECT time_bucket(1d, timestamp_ns) AS day, count(*) AS errors FROM logs WHERE severity_number >= 17 GROUP BY day) e ON b.day = e.day ORDER BY b.day",
        f"WITH days AS (SELECT timestamp_ns // {DAY} * {DAY} AS day, count(*) AS n FROM logs GROUP BY 1), busy AS (SELECT day, n FROM days WHERE n > 10) SELECT b.day, b.n, e.errors FROM busy b LEFT JOIN (SELECT timestamp_ns // {DAY} * {DAY} AS day, count(*) AS errors FROM logs WHERE severity_number >= 17 GROUP BY 1) e ON b.day = e.day".replace("WITH ", "", 1)),
    "scalars": (
        "SELECT event_id, abs(value - 100) AS a, floor(value) AS f, ceil(value) AS c, round(sqrt(value), 8) AS s, round(ln(value), 8) AS l, round(exp(value / 1000), 8) AS e, lower(name) AS lo, upper(name) AS up, length(name) AS n, trim(name) AS t, hex(name) AS h, coalesce(value_int, user_id, 7) AS k FROM metrics",
        "SELECT event_id, abs(value - 100) AS a, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(sqrt(value), 8) AS s, round(ln(value), 8) AS l, round(exp(value / 1000), 8) AS e, lower(name) AS lo, upper(name) AS up, length(name)::INT AS n, trim(name) AS t, lower(hex(name)) AS h, user_id AS k FROM metrics"),
    "json_and_severity": (
        "SELECT severity(severity_number) AS level, json(attributes, '$.k') AS k, count(*) AS n FROM logs GROUP BY level, k",
        "SELECT CASE severity_number WHEN 17 THEN 'ERROR' WHEN 13 THEN 'WARN' WHEN 9 THEN 'INFO' ELSE 'DEBUG' END AS level, json_extract_string(attributes, '$.k') AS k, count(*) AS n FROM logs GROUP BY 1, 2"),
}


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.anomalies(metric_rows(spark, sf_dir), ["value", "user_id"], ["event_id"])


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metric_rows(spark, sf_dir).select("value", "event_id", "timestamp_ns", (F.col("value") * 2 + 1).alias("twice"), "event_type")
    return rca.correlations(df, rca.numeric_columns(df))


def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rca.lag_correlations(metric_rows(spark, sf_dir), "timestamp_ns", "value", "user_id", 12 * HOUR, range(-5, 6))
    return out.select("lag", "n", F.round("r", 6).alias("r"))


def rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_z(metric_rows(spark, sf_dir), "value", ["timestamp_ns", "event_id"], ["event_type"], 20).select("event_id", F.round("z", 5).alias("z"))


def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.change(metric_rows(spark, sf_dir), "value", "timestamp_ns", ["timestamp_ns", "event_id"], ["event_type"]).select("event_id", F.round("change", 6).alias("change"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(metric_rows(spark, sf_dir), "timestamp_ns", ["timestamp_ns", "event_id"], ["user_id"], 6 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("start"), F.max("timestamp_ns").alias("end"))


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_per_group(metric_rows(spark, sf_dir), ["event_type"], [F.desc("value"), "event_id"], 3).select("event_type", "event_id", "value")


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir)
    errors = m.filter("event_type = 'error'").select("user_id", "timestamp_ns", "event_id")
    buys = m.filter("event_type = 'purchase'").groupBy("user_id", "timestamp_ns").agg(F.max("value").alias("value"))
    return joins.asof(errors, buys, ["user_id"], "timestamp_ns").select("event_id", F.col("timestamp_ns_asof").alias("bought_ns"), F.col("value_asof").alias("value"))


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir)
    spans = m.filter("event_type = 'error'").select(F.col("event_id").alias("span"), F.col("timestamp_ns").alias("low"), (F.col("timestamp_ns") + HOUR).alias("high"))
    return joins.within(m.select("event_id", "timestamp_ns"), spans, "timestamp_ns", "low", "high", HOUR).select("span", "event_id")


def join_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    small = joins.join(c, n, c.c_nationkey == n.n_nationkey, left_rows=150_000, right_rows=25)
    return joins.join(o, small, o.o_custkey == small.c_custkey, left_rows=1_500_000, right_rows=150_000).groupBy("n_name").agg(F.count("*").alias("n"))


def join_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of medium size: a hash join."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return joins.join(o, c, o.o_custkey == c.c_custkey, left_rows=900_000, right_rows=150_000).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    on = o.o_custkey == c.c_custkey
    a = c.join(o, on, "left_semi").select("c_custkey", F.lit("with").alias("kind"))
    return a.union(c.join(o, on, "left_anti").select("c_custkey", F.lit("without")))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir)
    a, b = m.filter("value > 100").select("user_id"), m.filter("event_type = 'error'").select("user_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    return functools.reduce(DataFrame.union, [d.select(F.lit(k).alias("kind"), "user_id") for k, d in parts.items()])


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_rows(spark, sf_dir).rollup("event_type", F.expr("user_id % 3").alias("third")).agg(F.count("*").alias("n"))


def bucketed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values counted into buckets by type, and the median read from the counts."""
    bounds = [10.0, 25.0, 50.0, 100.0, 200.0]
    m = metric_rows(spark, sf_dir)
    edges = [float("-inf"), *bounds, float("inf")]
    counts = m.groupBy("event_type").agg(*[F.sum(F.when((F.col("value") > lo) & (F.col("value") <= hi), 1).otherwise(0)).alias(f"c{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    h = counts.select("event_type", F.array(*[F.lit(b) for b in bounds]).alias("bounds"), F.array(*[F.col(f"c{i}") for i in range(len(bounds) + 1)]).alias("counts"))
    return h.select("event_type", F.round(temporal.bucket_quantile(0.5, F.col("bounds"), F.col("counts")), 6).alias("p50"))


def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ring.Ring([f"node{i}" for i in range(5)])
    return ring.assign(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", r, 3).select("c_custkey", F.concat_ws(",", "nodes").alias("nodes"))


OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "anomalies": (anomalies, f"WITH {M}, l AS (SELECT event_id, 'value' AS \"column\", value AS value FROM m UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE FROM m), z AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY \"column\")) / stddev_pop(value) OVER (PARTITION BY \"column\") AS z FROM l) SELECT event_id, \"column\", value, round(z, 2) AS z FROM z WHERE z > 3"),
    "correlations": (correlations, f"WITH {M}, d AS (SELECT value, event_id, timestamp_ns, value * 2 + 1 AS twice FROM m), p AS (SELECT 'value' AS a, 'event_id' AS b, corr(value, event_id) AS r FROM d UNION ALL SELECT 'value', 'timestamp_ns', corr(value, timestamp_ns) FROM d UNION ALL SELECT 'value', 'twice', corr(value, twice) FROM d UNION ALL SELECT 'event_id', 'timestamp_ns', corr(event_id, timestamp_ns) FROM d UNION ALL SELECT 'event_id', 'twice', corr(event_id, twice) FROM d UNION ALL SELECT 'timestamp_ns', 'twice', corr(timestamp_ns, twice) FROM d) SELECT a, b, round(r, 3) AS r FROM p WHERE abs(r) >= 0.8"),
    "lag_correlation": (lag_correlation, f"WITH {M}, b AS (SELECT timestamp_ns // {12 * HOUR} AS t, avg(value) AS a, avg(user_id) AS b FROM m GROUP BY 1), k AS (SELECT unnest(range(-5, 6)) AS lag) SELECT lag, count(*) AS n, round(corr(x.a, y.b), 6) AS r FROM k CROSS JOIN b x JOIN b y ON y.t = x.t + lag GROUP BY lag"),
    "rolling_z": (rolling_z, f"WITH {M} SELECT event_id, round(CASE WHEN s > 0 THEN (value - a) / s END, 5) AS z FROM (SELECT event_id, value, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM m WINDOW w AS (PARTITION BY event_type ORDER BY timestamp_ns, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"),
    "rate_of_change": (rate_of_change, f"WITH {M} SELECT event_id, round(CASE WHEN s > 0 THEN v / s END, 6) AS change FROM (SELECT event_id, (timestamp_ns - lag(timestamp_ns) OVER w) / 1e9 AS s, value - lag(value) OVER w AS v FROM m WINDOW w AS (PARTITION BY event_type ORDER BY timestamp_ns, event_id))"),
    "sessions": (sessions, f"WITH {M}, g AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS f FROM m WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_ns, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp_ns, event_id)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(timestamp_ns) AS start, max(timestamp_ns) AS \"end\" FROM s GROUP BY 1, 2"),
    "top_per_group": (top_per_group, f"WITH {M} SELECT event_type, event_id, value FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3"),
    "asof_join": (asof_join, f"WITH {M}, b AS (SELECT user_id, timestamp_ns, max(value) AS value FROM m WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, b.timestamp_ns AS bought_ns, b.value FROM m e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.timestamp_ns >= b.timestamp_ns WHERE e.event_type = 'error'"),
    "range_join": (range_join, f"WITH {M} SELECT s.event_id AS span, p.event_id FROM m s JOIN m p ON p.timestamp_ns BETWEEN s.timestamp_ns AND s.timestamp_ns + {HOUR} WHERE s.event_type = 'error'"),
    "join_strategies": (join_strategies, "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "join_hashed": (join_hashed, "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "semi_anti": (semi_anti, "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS kind FROM customer"),
    "set_operations": (set_operations, f"WITH {M}, a AS (SELECT user_id FROM m WHERE value > 100), b AS (SELECT user_id FROM m WHERE event_type = 'error') SELECT 'union' AS kind, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except_all', user_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"),
    "cube": (cube, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "rollup": (rollup, f"WITH {M} SELECT event_type, user_id % 3 AS third, count(*) AS n FROM m GROUP BY ROLLUP (event_type, user_id % 3)"),
    "bucketed_histogram": (bucketed_histogram, f"WITH {M}, b AS (SELECT unnest([0, 10, 25, 50, 100]) AS low, unnest([10, 25, 50, 100, 200]) AS high), c AS (SELECT event_type, low, high, count(*) FILTER (value > CASE WHEN low > 0 THEN low ELSE '-inf'::DOUBLE END AND value <= high) AS n, count(*) FILTER (value <= high) AS upto, count(*) AS total FROM m CROSS JOIN b GROUP BY 1, 2, 3) SELECT event_type, round(coalesce(arg_min(low + (high - low) * (0.5 * total - (upto - n)) / n, low) FILTER (n > 0 AND upto >= 0.5 * total), 200), 6) AS p50 FROM c GROUP BY 1"),
    "ring_assign": (ring_assign, "WITH v AS (SELECT 'node' || n AS node, substr(md5('node' || n || '#' || i), 1, 16) AS h FROM range(5) a(n), range(150) b(i)), k AS (SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 16) AS h FROM customer), d AS (SELECT c_custkey, node, min(CASE WHEN v.h >= k.h THEN '0' ELSE '1' END || v.h) AS place FROM k CROSS JOIN v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS n FROM d) SELECT c_custkey, string_agg(node, ',' ORDER BY place) AS nodes FROM r WHERE n <= 3 GROUP BY 1"),
}


def tables_of(q: s.Select | s.Compound | s.With) -> set[str]:
    """The tables that a statement names."""
    if isinstance(q, s.With):
        return tables_of(q.query).union(*(tables_of(x) for _, x in q.named)) - {name for name, _ in q.named}
    if isinstance(q, s.Compound):
        return tables_of(q.a) | tables_of(q.b)
    sources = (q.source, *(j.source for j in q.joins))
    return set().union(*(tables_of(x.query) if x.query else {x.table} for x in sources))


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = tables_of(parse(text))
    return lambda spark, sf_dir: engine(spark, sf_dir, tables).query(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _statement(text) for k, (text, _) in STATEMENTS.items()} | {k: f for k, (f, _) in OPERATORS.items()} | {k: f for k, (f, _) in io_queries.OPERATORS.items()}
ORACLE_SQL: dict[str, str] = {k: (WITH.rstrip() + ", " if sql.startswith("days AS") else WITH) + sql for k, (_, sql) in STATEMENTS.items()} | {k: sql for k, (_, sql) in OPERATORS.items() if sql} | {k: sql for k, (_, sql) in io_queries.OPERATORS.items()}
