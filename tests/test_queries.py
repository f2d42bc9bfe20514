"""Every query with SQL against DuckDB, and random statements."""

import glob
import math
import os
import random

import duckdb
import pyarrow.parquet as pq
import pytest

from tracemill import io_queries
from tracemill import queries as q
from tracemill.inputs import HOUR, NOW, engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted((tuple(plain(r[df.columns.index(c)]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    same(q.QUERIES[name](spark, DATA), duck.sql(q.ORACLE_SQL[name]))


def test_all_have_sql():
    assert set(q.QUERIES) == set(q.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bucket", "n", "per_second"] and e.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


class Random:
    """Statements that mean the same in both languages."""

    NUMBERS, TEXTS = ["event_id", "user_id", "severity_number"], ["body", "severity_text"]

    def __init__(self, seed):
        self.r = random.Random(seed)

    def number(self, depth=2):
        k = self.r.randrange(5 if depth else 2)
        if k == 0:
            return self.r.choice(self.NUMBERS)
        if k == 1:
            return str(self.r.randrange(0, 60))
        if k == 2:
            return f"-{self.number(0)}"
        return f"({self.number(depth - 1)} {self.r.choice('+-*')} {self.number(depth - 1)})" if k == 3 else f"({self.number(depth - 1)} % {self.r.randrange(2, 9)})"

    def condition(self, depth=3):
        k = self.r.randrange(9 if depth else 6)
        if k == 0:
            return f"{self.number()} {self.r.choice(['=', '!=', '<>', '<', '<=', '>', '>='])} {self.number()}"
        if k == 1:
            return f"{self.r.choice(self.TEXTS)} {self.r.choice(['', 'NOT '])}LIKE '{self.r.choice(['%e%', 'c_ick', 'v%', '%', 'error', '%_p'])}'"
        if k == 2:
            return f"{self.r.choice(self.TEXTS)} {self.r.choice(['', 'NOT '])}IN ('view', 'click', 'x')"
        if k == 3:
            return f"{self.number(1)} {self.r.choice(['', 'NOT '])}BETWEEN {self.number(0)} AND {self.number(0)}"
        if k == 4:
            return f"{self.r.choice(self.TEXTS)} IS {self.r.choice(['', 'NOT '])}NULL"
        if k == 5:
            return f"{self.r.choice(self.TEXTS)} = 'error'"
        if k == 6:
            return f"NOT ({self.condition(depth - 1)})"
        return f"({self.condition(depth - 1)} {self.r.choice(['AND', 'OR'])} {self.condition(depth - 1)})"

    def statement(self):
        where = f" WHERE {self.condition()}" if self.r.random() < 0.8 else ""
        kind = self.r.randrange(3)
        if kind == 0:
            return f"SELECT event_id, {self.number()} AS a, {self.r.choice(self.TEXTS)} AS b FROM logs{where}"
        key = self.r.choice([self.r.choice(self.TEXTS), f"{self.r.choice(self.NUMBERS)} % {self.r.randrange(2, 6)}"])
        aggregates = f"count(*) AS n, count(severity_text) AS m, min({self.number(1)}) AS lo, max({self.number(1)}) AS hi"
        having = f" HAVING count(*) > {self.r.randrange(0, 60)}" if self.r.random() < 0.5 else ""
        if kind == 1:
            return f"SELECT {key} AS k, {aggregates} FROM logs{where} GROUP BY {key}{having}"
        return f"SELECT DISTINCT {self.r.choice(self.TEXTS)} AS a, {self.r.choice(self.NUMBERS)} % 4 AS b FROM logs{where}"


@pytest.mark.parametrize("seed", range(40))
def test_random_statements(spark, duck, seed):
    text = Random(seed).statement()
    same(engine(spark, DATA).query(text), duck.sql(q.WITH + text))


@pytest.mark.parametrize("text,sql", [
    ("SELECT event_id, 1 AS one, 2.5 AS half, 'it''s' AS text, TRUE AS yes, INTERVAL '5 minutes' AS five, now() - 1h AS before FROM logs -- a comment\n;", f"SELECT event_id, 1 AS one, 2.5::DOUBLE AS half, 'it''s' AS text, TRUE AS yes, 300000000000 AS five, {NOW - HOUR} AS before FROM logs"),
    ('SELECT l.event_id "the id", l.user_id AS u, u * 2 AS twice, twice + 1 AS more FROM logs l', 'SELECT event_id AS "the id", user_id AS u, user_id * 2 AS twice, user_id * 2 + 1 AS more FROM logs'),
    ("SELECT event_id FROM logs ORDER BY event_id OFFSET 4",) * 2,
    ("SELECT event_id FROM logs ORDER BY user_id % 5 DESC, event_id",) * 2,
    ("SELECT event_id, severity_text FROM logs ORDER BY severity_text DESC, event_id", "SELECT event_id, severity_text FROM logs ORDER BY severity_text DESC NULLS LAST, event_id"),
])
def test_whole_tables(spark, duck, text, sql):
    """What literals, aliases, offset_alone, order_by_expression and order_nulls_last do to some rows, over all rows."""
    got, want = engine(spark, DATA).query(text), duck.sql(q.WITH + sql)
    if "ORDER" in text:
        assert [tuple(r) for r in got.collect()] == want.fetchall()
    same(got, want)


@pytest.mark.parametrize("name", ["stream_sessions", "stream_windows", "stream_join"])
def test_streams_of_many_files(spark, duck, monkeypatch, tmp_path, name):
    """No file holds all rows, so no task has to; the files are one batch, and none of their rows is late."""
    sizes = []

    def files(spark, out=io_queries.kept):
        monkeypatch.setattr(io_queries, "kept", lambda df, folder: sizes.extend(pq.read_metadata(p).num_rows for p in glob.glob(f"{folder}/in/*.parquet")) or out(df, folder))
        return str(tmp_path / "stream")

    monkeypatch.setattr(io_queries, "shared_folder", files)
    monkeypatch.setattr(io_queries, "FILE_ROWS", 100, raising=False)
    same(q.QUERIES[name](spark, DATA), duck.sql(q.ORACLE_SQL[name]))
    assert max(sizes) <= 100 and sum(sizes) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0] + 1
