import random
import re
from itertools import combinations

import numpy as np
import pytest

from tests.llm.conftest import DATA, prose
from tracemill.llm import superminhash as sm
from tracemill.llm.components import components


def shingles(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[a : a + sm.SHINGLE]) for a in range(max(1, len(w) - sm.SHINGLE + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_estimates_are_unbiased_and_vary_less_than_minhash():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.5, 0.8):
        u, est = 300, []
        common = int(2 * u * j / (1 + j))
        for _ in range(80):
            a = rng.integers(0, 2**63, u).astype(np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**63, u - common).astype(np.uint64)])
            s = sm.signatures(np.repeat([0, 1], u), np.concatenate([a, b]), 2)
            est.append((s[0] == s[1]).mean())
        true = common / (2 * u - common)
        assert abs(np.mean(est) - true) < 0.02
        assert np.std(est) < 1.1 * (true * (1 - true) / sm.M) ** 0.5


def test_signature_is_that_of_the_published_algorithm():
    """One element at a time, with its own permutation and no early stop."""
    from tracemill.llm import textkit as tk

    m, elements = 16, np.random.default_rng(3).integers(0, 2**63, 9).astype(np.uint64)
    want = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for e in elements:
        p = list(range(m))
        for j in range(m):
            x = int(tk.mix(np.array([(int(e) + (j + 1) * int(tk.GOLD)) % 2**64], np.uint64))[0])
            k = j + ((x >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(int(want[p[j]]), j << 40 | (x * int(tk.GOLD) % 2**64) >> 24)
    assert np.array_equal(sm.signatures(np.zeros(9, np.int64), elements, 1, m)[0], want)


def test_blocks_of_elements_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    row, element = np.sort(rng.integers(0, 9, 4000)), rng.integers(0, 2**63, 4000).astype(np.uint64)
    whole = sm.signatures(row, element, 10)
    monkeypatch.setattr(sm, "BLOCK", 70)
    assert np.array_equal(sm.signatures(row, element, 10), whole)


def test_groups_against_all_pairs(make):
    docs, clean = [], []
    for g in range(25):
        base = prose(g, 60 + 20 * g)
        docs.append(base)
        docs += [base if v == 0 else edited(base, 0.015 * v, 100 * g + v) for v in range(4)]
    clean = [prose(10_000 + i, 200) for i in range(60)]
    docs += clean
    got = {r.doc_id: r.group_id for r in sm.groups(make(docs)).collect()}
    s = [shingles(t) for t in docs]
    pairs = [(a, b) for a, b in combinations(range(len(docs)), 2) if jaccard(s[a], s[b]) >= sm.THRESHOLD]
    hit = sum(a in got and got.get(a) == got.get(b) for a, b in pairs)
    assert hit >= 0.97 * len(pairs) > 100
    assert not any(i in got for i in range(len(docs) - len(clean), len(docs)))


def test_many_copies_are_one_group(make):
    base = prose(1, 120)
    docs = [base] * 700 + [edited(base, 0.01, i) for i in range(700)] + [prose(9, 80)]
    rows = sm.groups(make(docs)).collect()
    assert len(rows) == 1400 and {r.group_id for r in rows} == {0} and sum(r.keep for r in rows) == 1


def test_odd_rows(make):
    docs = [(1, None), (2, ""), (3, " .,! "), (4, "word"), (5, "WORD!"), (6, "two words"), (None, "word"), (7, prose(1, 20_000)), (8, prose(1, 20_000) + " tail"), (9, prose(2, 50)), (9, prose(2, 50)), (10, "")]
    got = sorted((r.doc_id, r.group_id, r.keep, r.links) for r in sm.groups(make(docs)).collect())
    assert got == [(4, 4, True, 1), (5, 4, False, 1), (7, 7, True, 1), (8, 7, False, 1), (9, 9, False, 1), (9, 9, True, 1)]
    kept = sm.drop_near_duplicates(make(docs, {"group_id": "g", "bands": "b"}))
    assert kept.columns[-2:] == ["group_id", "bands"]
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, 1, 2, 3, 4, 6, 7, 9, 10]


def test_rows_not_ids_stay_or_go(make, spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (4, b + " tail"), (5, prose(34, 60))]
    kept = sm.drop_near_duplicates(make(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b), (3, c), (5, rows[7][1])])
    text_ids = make(rows).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert sorted((r.doc_id, r.group_id, r.keep) for r in sm.groups(text_ids).collect()) == [("d1", "d1", True), ("d2", "d1", False), ("d2", "d2", True), ("d3", "d3", False), ("d3", "d3", False), ("d3", "d3", True), ("d4", "d2", False)]
    assert sm.drop_near_duplicates(text_ids).count() == 4


def test_columns_of_any_name_are_kept(make):
    from pyspark.sql import functions as F

    odd = {k: k for k in ("__gone", "key", "KEY_", "doc_id_as_text", "node", "group_id", "keep", "some", "n")}
    docs = make([prose(1, 50), prose(1, 50), prose(2, 50)], {k: v for k, v in odd.items() if k != "KEY_"}).withColumn("tick`s", F.lit("t")).withColumn("a.b", F.lit("u"))
    kept = sm.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert all(r["tick`s"] == "t" and r["a.b"] == "u" and r["__gone"] == "__gone" and r["key"] == "key" for r in kept.collect())


def test_near_copies_without_spaces_between_words(make):
    r = random.Random(4)
    sign = lambda: chr(r.randrange(0x4E00, 0x9FA0))
    base = "".join(sign() for _ in range(300))
    near = base[:150] + sign() + base[150:]
    got = {x.doc_id: x.group_id for x in sm.groups(make([base, near, "".join(sign() for _ in range(300))])).collect()}
    assert got == {0: 0, 1: 0}


def test_large_buckets_are_compared_by_parts(make, monkeypatch):
    base = prose(1, 120)
    docs = [edited(base, 0.02, i) for i in range(60)] + [prose(100 + i, 80) for i in range(20)]
    want = sorted(tuple(r) for r in sm.groups(make(docs)).collect())
    import pyarrow as pa

    nodes = np.arange(50, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(50, np.int64)), pa.array(nodes)], ["band", "node"])
    monkeypatch.setattr(sm, "PART", 7)
    seen = set()
    for b in sm._buckets(iter([batch])):
        by = {}
        for bucket, node in zip(*(c.to_pylist() for c in b.columns)):
            by.setdefault(bucket, []).append(node)
        for x in by.values():
            assert len(x) <= 14
            seen.update(combinations(x, 2))
    assert seen == set(combinations(range(50), 2))
    assert len(want) == 60


def test_sieve_passes_every_wanted_key(spark):
    from pyspark.sql import functions as F

    from tracemill.llm.sieve import sieve

    keys = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("k"))
    test = sieve(keys)
    assert keys.filter(~test(F.col("k"))).count() == 0
    assert spark.range(1, 30_000, 3).select(F.xxhash64("id").alias("k")).filter(test(F.col("k"))).count() < 20
    assert spark.range(50).filter(sieve(keys.limit(0))(F.col("id"))).count() == 0


def test_empty(make):
    assert sm.groups(make([])).collect() == []
    assert sm.drop_near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {tuple(x) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_on_the_small_tables(spark):
    rows = sm.op7_superminhash(spark, f"{DATA}/sf0.001").collect()
    docs = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    group = {r.doc_id: r.group_id for r in rows}
    pairs = [(a, b) for a, b in combinations(docs, 2) if jaccard(docs[a], docs[b]) >= sm.THRESHOLD]
    assert sum(a in group and group.get(a) == group.get(b) for a, b in pairs) >= 0.95 * len(pairs)
    for i, g in group.items():
        near = [jaccard(docs[i], docs[k]) for k, h in group.items() if h == g and k != i]
        assert max(near) > sm.THRESHOLD - 0.15


def test_pairs_that_stand_alone_about_the_threshold(make):
    docs, true = [], []
    for k in range(240):
        words = [f"p{k}w{i}" for i in range(300)]
        shared = (188 + k % 13) if k < 120 else (203 + k % 13)
        docs += [" ".join(words), " ".join(words[:shared] + [w + "x" for w in words[shared:]])]
        true.append(jaccard(*map(shingles, docs[-2:])))
    got = {r.doc_id: r.group_id for r in sm.groups(make(docs)).collect()}
    hit = [2 * k in got for k in range(240)]
    far, near = [h for h, j in zip(hit, true) if j < sm.THRESHOLD], [h for h, j in zip(hit, true) if sm.THRESHOLD <= j < 0.57]
    assert len(far) > 100 and len(near) > 100
    assert not any(far) and sum(near) >= 0.95 * len(near)
    assert all(got.get(2 * k) == got.get(2 * k + 1) for k in range(240))
