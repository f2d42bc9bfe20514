"""Queries that decode, store, stream and hand out, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import nl
from tracemill.engine import Engine
from tracemill.errors import QueryError
from tracemill.inputs import DAY, HOUR, M, NOW, T0, T1, T2, WITH, binary_requests, engine, events_ns, json_requests, kept, metric_rows, shared_folder
from tracemill.operators import rca, ring
from tracemill.plans.parser import parse
from tracemill.sources import feedback, otlp, otlp_binary, results, store
from tracemill.streaming import ingest

# Decoding


def otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = otlp.logs(json_requests(spark, sf_dir, "logs"))
    return d.select("timestamp_ns", "observed_timestamp_ns", "severity_number", "body", "attributes", F.get_json_object("resource_attributes", "$['service.name']").alias("service"), "scope_name")


def otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = otlp.metrics(json_requests(spark, sf_dir, "metrics"))
    return d.select("timestamp_ns", "name", F.col("metric_type").cast("int").alias("metric_type"), "value_double", "attributes", "scope_name")


def _spans(d: DataFrame) -> DataFrame:
    return d.select(F.lower(F.hex("trace_id")).alias("trace_id"), F.lower(F.hex("span_id")).alias("span_id"), "name", "kind", "start_time_ns", "duration_ns", "status_code", "events", "links")


def otlp_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(otlp.traces(json_requests(spark, sf_dir, "traces")))


def otlp_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are lists of keys and values, with arrays in arrays."""
    number = F.col("event_id").cast("string")
    array = lambda *x: ['{"arrayValue":{"values":[', *x, "]}}"]
    path = array('{"intValue":"', number, '"},', *array(*array(*array('{"boolValue":true}'))))
    parts = ['{"kvlistValue":{"values":[{"key":"type","value":{"stringValue":"', F.col("event_type"), '"}},{"key":"raw","value":{"bytesValue":"AP8="}},{"key":"path","value":', *path, "}]}}"]
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return otlp.logs(json_requests(spark, sf_dir, "logs", body)).select("timestamp_ns", "body")


def otlp_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which every third was cut short: how many are rejected, how many decoded."""
    cut = F.when(F.get_json_object("value", "$.resourceLogs[0].scopeLogs[0].logRecords[0].attributes[0].value.intValue").cast("long") % 3 == 0, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value"))
    df = json_requests(spark, sf_dir, "logs").select(cut.alias("value"))
    return otlp.rejected(df).agg(F.count("*").alias("rejected")).crossJoin(otlp.logs(df).agg(F.count("*").alias("decoded")))


def otlp_binary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = otlp_binary.decode(binary_requests(spark, sf_dir, "logs"), "logs")
    return d.select("timestamp_ns", "observed_timestamp_ns", "severity_number", "body", "attributes", F.get_json_object("resource_attributes", "$['service.name']").alias("service"), "scope_name")


def otlp_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = otlp_binary.decode(binary_requests(spark, sf_dir, "metrics"), "metrics")
    return d.select("timestamp_ns", "name", F.col("metric_type").cast("int").alias("metric_type"), "value_int", "histogram_count", "scope_name")


def otlp_binary_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(otlp_binary.decode(binary_requests(spark, sf_dir, "traces"), "traces"))


# Stores


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("part", "body").agg(F.count("*").alias("n"))


def store_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    store.write(otlp.logs(json_requests(spark, sf_dir, "logs")), "logs", path, DAY)
    e = store.register(Engine(spark), "logs", path, DAY)
    return kept(e.query(f"SELECT timestamp_ns, body, service_name FROM logs WHERE timestamp_ns >= {T0} AND timestamp_ns < {T1}"), path)


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, logs = shared_folder(spark), otlp.logs(json_requests(spark, sf_dir, "logs"))
    for _ in range(4):
        store.write(logs, "logs", path, DAY)
    store.compact(spark, "logs", path, width=DAY)
    store.vacuum(spark, path, 0)
    return kept(_counts(store.read(spark, path)), path)


def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    store.write(otlp.metrics(json_requests(spark, sf_dir, "metrics")), "metrics", path, DAY)
    e = store.register(Engine(spark), "metrics", path, DAY)
    return kept(e.query("SELECT metric_name, part, count(*) AS n, round(sum(value), 4) AS total FROM metrics GROUP BY metric_name, part"), path)


def store_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    store.write(otlp.traces(json_requests(spark, sf_dir, "traces")), "traces", path, DAY)
    return kept(_spans(store.read(spark, path)).select("trace_id", "span_id", "name", "start_time_ns", "duration_ns"), path)


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of one trace, by the bloom filters of its column."""
    path = shared_folder(spark)
    store.write(otlp.traces(json_requests(spark, sf_dir, "traces")), "traces", path, DAY)
    found = store.read(spark, path).filter(F.col("trace_id") == F.unhex(F.lit(f"{5:032x}")))
    return kept(_spans(found).select("trace_id", "span_id", "name", "start_time_ns"), path)


def store_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions before T1 are moved to a second store; both are read."""
    hot, cold = shared_folder(spark), shared_folder(spark)
    store.write(otlp.logs(json_requests(spark, sf_dir, "logs")), "logs", hot, DAY)
    store.move(spark, hot, cold, T1)
    both = store.read(spark, hot).withColumn("tier", F.lit("hot")).union(store.read(spark, cold).withColumn("tier", F.lit("cold")))
    return kept(kept(both.groupBy("tier", "part").agg(F.count("*").alias("n")), hot), cold)


def _land(requests: DataFrame, folder: str) -> None:
    """Requests as files of one a line, among four files."""
    requests.repartition(4).write.mode("append").text(f"{folder}/landing")


def _take(spark: SparkSession, folder: str, **how) -> None:
    ingest.ingest(spark, f"{folder}/landing", f"{folder}/store", f"{folder}/checkpoint", "logs", DAY, lines=True, **how).awaitTermination()


def store_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third streamed, a third written as a batch, compacted, and the last third streamed again."""
    folder = shared_folder(spark)
    path = f"{folder}/store"
    third = lambda k: json_requests(spark, sf_dir, "logs", where=f"event_id % 3 = {k}")
    _land(third(0), folder)
    _take(spark, folder)
    store.write(otlp.logs(third(1)), "logs", path, DAY)
    store.compact(spark, "logs", path, least=2, width=DAY)
    _land(third(2), folder)
    _take(spark, folder)
    return kept(_counts(store.read(spark, path)), folder)


def store_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped midway, with files of a batch that it never published, and goes on."""
    folder = shared_folder(spark)
    path = f"{folder}/store"
    _land(json_requests(spark, sf_dir, "logs"), folder)
    q = ingest.ingest(spark, f"{folder}/landing", path, f"{folder}/checkpoint", "logs", DAY, files_per_trigger=1, every="0 seconds", lines=True)
    while q.isActive and not store.commits(spark, path):
        time.sleep(0.05)
    q.stop()
    done = len(store.commits(spark, path))
    half = store.partitioned(otlp.logs(json_requests(spark, sf_dir, "logs", where="event_id % 2 = 0")), "logs", DAY)
    store.stage(half, "logs", path, f"{q.id}-{done}")
    _take(spark, folder, files_per_trigger=1)
    return kept(_counts(store.read(spark, path)), folder)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    _land(json_requests(spark, sf_dir, "logs"), folder)
    _take(spark, folder, files_per_trigger=2)
    return kept(_counts(store.read(spark, f"{folder}/store")), folder)


def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives is written out by its size: a commit for about each fourth of it."""
    folder = shared_folder(spark)
    _land(json_requests(spark, sf_dir, "logs"), folder)
    _take(spark, folder, bytes_per_trigger=1)
    commits = len(store.commits(spark, f"{folder}/store"))
    return kept(store.read(spark, f"{folder}/store").groupBy("part").agg(F.count("*").alias("n")).withColumn("commits", F.lit(commits)), folder)


# Streams of events. A last row far ahead lets the watermark pass all others.

_FAR = T2 + 400 * DAY
#: Most rows of a file that a stream reads, so that no task has to take more of them at once than its share of the bytes.
FILE_ROWS = 250_000


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    folder = shared_folder(spark)
    e = metric_rows(spark, sf_dir)
    last = spark.createDataFrame([(-1, _FAR, -1, "end", 0.0)], e.schema)
    # Files of any number: without a limit a stream takes all that is there as one batch, so no row comes late.
    e.union(last).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/in")
    out = build(spark.readStream.schema(e.schema).parquet(f"{folder}/in"))
    out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept(spark.read.schema(out.schema).parquet(f"{folder}/out"), folder)


def _window_rows(df: DataFrame) -> DataFrame:
    ns = lambda c: (F.unix_micros(c) * 1000).alias(f"{c}_ns")
    return df.select(ns("start"), ns("end"), *[c for c in df.columns if c not in ("start", "end")])


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda d: _window_rows(ingest.windowed_counts(d, "logs", ["event_type"], "1 day", "1 hour"))).filter("event_type != 'end'")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda d: _window_rows(ingest.windowed_counts(d, "logs", ["event_type"], "1 day", "1 hour", "12 hours"))).filter("event_type != 'end'")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda d: _window_rows(ingest.sessions(d, "logs", ["user_id"], "6 hours", "1 hour"))).filter("user_id != -1")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda d: ingest.once(d, "logs", ["user_id", "event_type"], "1 hour").select("user_id", "event_type")).filter("user_id != -1")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the purchases of the same user in the hour after."""

    def build(d: DataFrame) -> DataFrame:
        keep = lambda kind: d.filter(F.col("event_type").isin(kind, "end")).select("event_id", "user_id", "timestamp_ns")
        return ingest.join_within(keep("error"), keep("purchase"), "logs", ["user_id"], "1 hour", "1 hour").select(F.col("event_id").alias("error"), F.col("right_event_id").alias("purchase"))

    return _streamed(spark, sf_dir, build).filter("error != -1")


# Results and feedback


def result_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.ndjson(engine(spark, sf_dir, {"logs"}).query("SELECT event_id, severity_text, user_id FROM logs"))


def result_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = results.arrow(engine(spark, sf_dir, {"metrics"}).query("SELECT name, count(*) AS n, round(sum(value), 4) AS total FROM metrics GROUP BY name"))
    return spark.createDataFrame(table)


def _feedback(spark: SparkSession) -> tuple[feedback.Feedback, str]:
    folder, clock = shared_folder(spark), iter(range(100))
    f = feedback.Feedback(spark, folder, now=lambda: next(clock))
    keys = [f.add(f"question {i}", f"select {i}") for i in range(3)]
    for i, taken in ((0, True), (1, False), (2, True), (0, False), (1, True)):
        f.rate(keys[i], taken)
    return f, folder


def feedback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, folder = _feedback(spark)
    return kept(f.history().select("question", "query", "accepted"), folder)


def feedback_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, folder = _feedback(spark)
    rows = [(i, *x) for i, x in enumerate(f.examples())]
    return kept(spark.createDataFrame(rows, "place int, question string, query string"), folder)


# Root causes, questions and the grammar


def rca_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest anomalies, as the report has them. A top-k report: the limit is the feature."""
    r = rca.report(metric_rows(spark, sf_dir).select("event_id", "value"), "what is odd?", ["event_id"])
    return spark.createDataFrame([(x["column"], x["event_id"], x["value"], x["z"], f"Anomaly: {x['column']} = {x['value']:g} (z = {x['z']:.2f})" in r.context) for x in r.anomalies], "column string, event_id long, value double, z double, told boolean")


def rca_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rca.report(metric_rows(spark, sf_dir).filter("value < 0"))
    return spark.createDataFrame([(r.summary, len(r.anomalies), len(r.correlations))], "summary string, anomalies int, correlations int")


def lag_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metric_rows(spark, sf_dir).withColumn("twice", F.col("value") * 2)
    return rca.significant(rca.lag_correlations(m, "timestamp_ns", "value", "twice", 12 * HOUR, range(-5, 6))).select("lag", "n", F.round("r", 6).alias("r"))


QUESTIONS = ("why did it fail?", "what is the cpu doing", "which spans are slow", "hello")


def nl_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that each question is answered from, and how many rows the answer has."""
    e = engine(spark, sf_dir, {"logs", "metrics", "traces"})
    rows = [(q, parse(text).source.table, e.query(text).count()) for q in QUESTIONS for text in [nl.to_query(q)]]
    return spark.createDataFrame(rows, "question string, source string, n long")


def grammar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements drawn from the grammar: all are statements of the language."""
    e, n = engine(spark, sf_dir, {"logs", "metrics", "traces"}), 300
    rules, parsed = nl.grammar(e.catalog), 0
    for seed in range(n):
        try:
            parse(nl.sample(rules, seed))
            parsed += 1
        except QueryError:
            pass
    return spark.createDataFrame([(n, parsed)], "samples int, parsed int")


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"metrics"}).function("scaled", lambda x, by=2: x * F.lit(by), 1, 2)
    return e.query("SELECT event_id, round(scaled(value, 3), 6) AS x FROM metrics WHERE scaled(user_id) > 10")


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"metrics"}).query("SELECT name, approx_count_distinct(user_id) AS about, count_distinct(user_id) AS users FROM metrics GROUP BY name")
    return e.select("name", "users", (F.abs(F.col("about") - F.col("users")) <= 0.15 * F.col("users")).alias("near"))


def ring_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by series: a metric's name and its sorted labels."""
    d = events_ns(spark, sf_dir).select("event_id", ring.series_key("event_type", "props").alias("series"))
    return ring.assign(d, "series", ring.Ring([f"node{i}" for i in range(5)])).select("event_id", "series", F.col("nodes")[0].alias("node"))


_ALL = f"SELECT epoch_us(ts) * 1000 // {DAY} * {DAY} AS part, event_type AS body, count(*) AS n FROM events GROUP BY 1, 2"
_LOGS = "SELECT epoch_us(ts) * 1000 AS timestamp_ns, epoch_us(ts) * 1000 AS observed_timestamp_ns, 9 AS severity_number, event_type AS body, '{\"id\":' || %s || '}' AS attributes, 'svc' || user_id %% 5 AS service, 'test' AS scope_name FROM events"
_VIRTUAL = "v AS (SELECT 'node' || n AS node, substr(md5('node' || n || '#' || i), 1, 16) AS h FROM range(5) a(n), range(150) b(i))"
_SPAN = "SELECT lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, lpad(lower(to_hex(user_id)), 16, '0') AS span_id, event_type AS name"
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "otlp_logs": (otlp_logs, _LOGS % "event_id"),
    "otlp_metrics": (otlp_metrics, "SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_type AS name, 0 AS metric_type, value AS value_double, NULL::VARCHAR AS attributes, 'test' AS scope_name FROM events"),
    "otlp_traces": (otlp_traces, f"{_SPAN}, 2 AS kind, epoch_us(ts) * 1000 AS start_time_ns, greatest(floor((value - 50) * 1000)::BIGINT, 0) AS duration_ns, 1 AS status_code, '[]' AS events, '[]' AS links FROM events WHERE event_id % 7 <> 0"),
    "otlp_nested": (otlp_nested, "SELECT epoch_us(ts) * 1000 AS timestamp_ns, '{\"type\":\"' || event_type || '\",\"raw\":\"AP8=\",\"path\":[' || event_id || ',[[[true]]]]}' AS body FROM events"),
    "otlp_rejected": (otlp_rejected, "SELECT count(*) FILTER (event_id % 3 = 0) AS rejected, count(*) FILTER (event_id % 3 <> 0) AS decoded FROM events"),
    "otlp_binary_logs": (otlp_binary_logs, _LOGS % "'\"' || event_id || '\"'"),
    "otlp_binary_metrics": (otlp_binary_metrics, "SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_type AS name, 0 AS metric_type, event_id AS value_int, NULL::BIGINT AS histogram_count, 'test' AS scope_name FROM events UNION ALL SELECT epoch_us(ts) * 1000, 'h', 2, NULL, user_id, 'test' FROM events"),
    "otlp_binary_traces": (otlp_binary_traces, f"{_SPAN}, 2 AS kind, epoch_us(ts) * 1000 AS start_time_ns, event_id AS duration_ns, 1 AS status_code, '[]' AS events, '[]' AS links FROM events"),
    "store_pruned_read": (store_pruned_read, f"SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_type AS body, 'svc' || user_id % 5 AS service_name FROM events WHERE epoch_us(ts) * 1000 >= {T0} AND epoch_us(ts) * 1000 < {T1}"),
    "store_compacted": (store_compacted, _ALL.replace("count(*)", "4 * count(*)")),
    "store_metrics": (store_metrics, f"SELECT event_type AS metric_name, epoch_us(ts) * 1000 // {DAY} * {DAY} AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "store_traces": (store_traces, f"{_SPAN}, epoch_us(ts) * 1000 AS start_time_ns, greatest(floor((value - 50) * 1000)::BIGINT, 0) AS duration_ns FROM events WHERE event_id % 7 <> 0"),
    "store_lookup": (store_lookup, f"{_SPAN}, epoch_us(ts) * 1000 AS start_time_ns FROM events WHERE event_id = 5"),
    "store_tiers": (store_tiers, f"SELECT CASE WHEN epoch_us(ts) * 1000 < {T1} THEN 'cold' ELSE 'hot' END AS tier, epoch_us(ts) * 1000 // {DAY} * {DAY} AS part, count(*) AS n FROM events GROUP BY 1, 2"),
    "store_mixed": (store_mixed, _ALL),
    "store_restart": (store_restart, _ALL),
    "stream_ingest": (stream_ingest, _ALL),
    "stream_flush": (stream_flush, f"SELECT epoch_us(ts) * 1000 // {DAY} * {DAY} AS part, count(*) AS n, 4 AS commits FROM events GROUP BY 1"),
    "stream_windows": (stream_windows, f"SELECT epoch_us(ts) * 1000 // {DAY} * {DAY} AS start_ns, epoch_us(ts) * 1000 // {DAY} * {DAY} + {DAY} AS end_ns, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_sliding": (stream_sliding, f"WITH s AS (SELECT (epoch_us(ts) * 1000 // {12 * HOUR} - k) * {12 * HOUR} AS start_ns, event_type FROM events, range(2) r(k)) SELECT start_ns, start_ns + {DAY} AS end_ns, event_type, count(*) AS n FROM s GROUP BY ALL"),
    "stream_sessions": (stream_sessions, f"WITH {M}, g AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS f FROM m WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_ns, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY timestamp_ns, event_id) AS k FROM g) SELECT min(timestamp_ns) AS start_ns, max(timestamp_ns) + {6 * HOUR} AS end_ns, user_id, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_once": (stream_once, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_join": (stream_join, f"WITH {M} SELECT a.event_id AS error, b.event_id AS purchase FROM m a JOIN m b ON a.user_id = b.user_id AND b.timestamp_ns BETWEEN a.timestamp_ns AND a.timestamp_ns + {HOUR} WHERE a.event_type = 'error' AND b.event_type = 'purchase'"),
    "result_ndjson": (result_ndjson, "SELECT '{\"event_id\":' || event_id || ',\"severity_text\":' || CASE WHEN event_type = 'click' THEN 'null' ELSE '\"' || event_type || '\"' END || ',\"user_id\":' || user_id || '}' AS value FROM events"),
    "result_arrow": (result_arrow, "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "feedback_history": (feedback_history, "SELECT * FROM (VALUES ('question 0', 'select 0', false), ('question 1', 'select 1', true), ('question 2', 'select 2', true)) v(question, query, accepted)"),
    "feedback_examples": (feedback_examples, "SELECT * FROM (VALUES (0, 'question 1', 'select 1'), (1, 'question 2', 'select 2')) v(place, question, query)"),
    "rca_report": (rca_report, f"WITH {M}, z AS (SELECT event_id, value, round(abs(value - avg(value) OVER ()) / stddev_pop(value) OVER (), 2) AS z, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () > 3 AS odd FROM m) SELECT 'value' AS \"column\", event_id, value, z, true AS told FROM z WHERE odd ORDER BY z DESC, event_id LIMIT 10"),
    "rca_empty": (rca_empty, f"SELECT '{rca.NO_DATA}' AS summary, 0 AS anomalies, 0 AS correlations"),
    "lag_significant": (lag_significant, f"WITH {M}, b AS (SELECT timestamp_ns // {12 * HOUR} AS t, avg(value) AS a, avg(value * 2) AS b FROM m GROUP BY 1), k AS (SELECT unnest(range(-5, 6)) AS lag), r AS (SELECT lag, count(*) AS n, corr(x.a, y.b) AS r FROM k CROSS JOIN b x JOIN b y ON y.t = x.t + lag GROUP BY lag) SELECT lag, n, round(r, 6) AS r FROM r WHERE abs(r) > 0.7 AND n > 3"),
    "nl_questions": (nl_questions, WITH + f"SELECT 'why did it fail?' AS question, 'logs' AS source, (SELECT least(count(*), 200) FROM logs WHERE severity_number >= 17 AND timestamp_ns > {NOW - DAY} AND timestamp_ns <= {NOW}) AS n UNION ALL SELECT 'what is the cpu doing', 'metrics', (SELECT count(DISTINCT (timestamp_ns // {300 * 10**9}, name)) FROM metrics WHERE timestamp_ns > {NOW - DAY} AND timestamp_ns <= {NOW}) UNION ALL SELECT 'which spans are slow', 'traces', (SELECT least(count(*), 20) FROM (SELECT name FROM traces WHERE timestamp_ns > {NOW - 7 * DAY} AND timestamp_ns <= {NOW} GROUP BY name)) UNION ALL SELECT 'hello', 'logs', (SELECT count(DISTINCT severity_number) FROM logs WHERE timestamp_ns > {NOW - DAY} AND timestamp_ns <= {NOW})"),
    "grammar_samples": (grammar_samples, "SELECT 300 AS samples, 300 AS parsed"),
    "own_function": (own_function, "SELECT event_id, round(value * 3, 6) AS x FROM events WHERE user_id * 2 > 10"),
    "approx_distinct": (approx_distinct, "SELECT event_type AS name, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1"),
    "ring_series": (ring_series, f"WITH {_VIRTUAL}, k AS (SELECT DISTINCT event_type || chr(31) || 'k=' || json_extract_string(props, '$.k') AS series FROM events), d AS (SELECT series, node, row_number() OVER (PARTITION BY series ORDER BY CASE WHEN h >= substr(md5(series), 1, 16) THEN 0 ELSE 1 END, h) AS n FROM k CROSS JOIN v) SELECT event_id, series, node FROM events JOIN d ON series = event_type || chr(31) || 'k=' || json_extract_string(props, '$.k') WHERE n = 1"),
}
