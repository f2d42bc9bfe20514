import hashlib
import math
from collections import Counter

import duckdb
import pytest

from tests.llm.conftest import DATA
from tracemill.llm import sharding as sh


def by_hand(key, root):
    """Down the tree, one draw at a time."""
    path, node = [], root
    while node.children:
        draws = []
        for i, c in enumerate(node.children):
            if c.total > 0:
                h = int(hashlib.md5(f"{key}|{c.name}".encode()).hexdigest()[:13], 16)
                draws.append((-math.log((h + 0.5) / 2**52) / c.total, i, c))
        node = min(draws)[2]
        path.append(node.name)
    return tuple(path)


def shards(df, root=sh.PRODUCTION):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in sh.assign(df, "doc_id", root).collect()}


def test_as_by_hand_and_in_proportion(spark):
    got = shards(spark.range(4000).withColumnRenamed("id", "doc_id"))
    assert all(got[k] == by_hand(k, sh.PRODUCTION) for k in range(0, 4000, 7))
    n = Counter(v[2] for v in got.values())

    def leaves(node):
        return [node] if not node.children else [x for c in node.children for x in leaves(c)]

    for leaf in leaves(sh.PRODUCTION):
        share = leaf.total / sh.PRODUCTION.total
        assert abs(n[leaf.name] / 4000 - share) < 5 * (share / 4000) ** 0.5


def test_movement_is_confined_to_the_subtree(spark):
    spec = {"a": {"x": {"1": 1, "2": 1}, "y": {"1": 1, "2": 1}}, "b": {"x": {"1": 2, "2": 2}}}
    same_sum = {"a": {"x": {"1": 0.5, "2": 1.5}, "y": {"1": 1, "2": 1}}, "b": {"x": {"1": 2, "2": 2}}}
    more = {"a": {"x": {"1": 1, "2": 1}, "y": {"1": 1, "2": 1}}, "b": {"x": {"1": 3, "2": 2}}}
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    inside = sh.moves(df, sh.tree(spec), sh.tree(same_sum)).collect()
    assert inside and {(r["from"], r["to"]) for r in inside} == {("a/x/1", "a/x/2")}
    gained = sh.moves(df, sh.tree(spec), sh.tree(more)).collect()
    # b, b/x and b/x/1 all weigh more: what moves goes into b, and inside b to b/x/1 only; nothing moves inside a.
    assert gained and all(r["to"].startswith("b/") for r in gained)
    assert {r["to"] for r in gained if r["from"].startswith("b/")} == {"b/x/1"}
    assert len(gained) < 3000 * 0.3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, draw string")
    rows = sh.assign(df).collect()
    assert len(rows) == 3 and rows[0][2:] == rows[1][2:]
    assert [r[2:] for r in rows if r.doc_id is None] == [(None, None, None)]
    assert sh.assign(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sh.assign(df, root=sh.tree({"a": {"x": {"1": 0}}}))
    only = sh.tree({"a": {"x": {"1": 0, "2": 5}}})
    assert {r.shard for r in sh.assign(df.filter("doc_id = 1"), root=only).collect()} == {"a/x/2"}


def test_columns_and_keys_of_any_name(spark):
    df = spark.createDataFrame([("a", "eu-west", "t"), ("b", "us-east", "u")], "doc_id string, Region string, `tick``s` string")
    out = sh.assign(df)
    assert out.columns == ["doc_id", "Region", "tick`s", "region_", "rack", "shard"]
    for r in out.collect():
        assert (r.region_, r.rack, r.shard) == by_hand(r.doc_id, sh.PRODUCTION) and r.Region in ("eu-west", "us-east")
    assert [r[3:] for r in sh.assign(df.withColumnRenamed("doc_id", "my id"), "my id").orderBy("my id").collect()] == [r[3:] for r in out.orderBy("doc_id").collect()]


def test_thousands_of_shards(spark):
    big = sh.tree({f"g{a}": {f"r{b}": {f"s{c}": 1 + (a + b + c) % 3 for c in range(20)} for b in range(20)} for a in range(10)})
    got = shards(spark.range(300).withColumnRenamed("id", "doc_id"), big)
    assert all(v == by_hand(k, big) for k, v in got.items())


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
    want = {r[0]: r[1:] for r in c.sql(sh.sql()).fetchall()}
    assert {r.doc_id: (r.region, r.rack, r.shard) for r in sh.op5_sharding(spark, f"{DATA}/sf0.01").collect()} == want
