import random
import re

import pytest

from tests.llm.conftest import DATA, prose
from tracemill.llm import decontamination as dc

N = dc.SHINGLE


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def grams(w):
    return [tuple(w[a : a + N]) for a in range(len(w) - N + 1)] if len(w) >= N else [tuple(w)] if w else []


def brute(docs, items, threshold=dc.THRESHOLD):
    out = []
    for d, t in docs:
        for i, x in items:
            g = grams(words(t))
            s, n = set(grams(words(x))), len(words(x))
            if d is None or i is None or not s:
                continue
            width = max(1, n - N + 1)
            if n < N:
                w = words(t)
                g = [tuple(w[a : a + n]) for a in range(len(w) - n + 1)]
            best = max(((len(s & set(g[a : a + width])), -a) for a in range(len(g)) if g[a] in s), default=(0, 0))
            if best[0] >= threshold * len(s) - 1e-9:
                out.append((d, i, round(best[0] / len(s), 6), -best[1], -best[1] + n))
    return sorted(out)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(docs, bench, **kw):
    return sorted(tuple(r) for r in dc.leaks(docs, bench, **kw).collect())


@pytest.mark.parametrize("limit", [dc.SLICE_SHINGLES, 40, 1])
def test_as_brute_force_in_any_number_of_slices(spark, make, limit):
    r = random.Random(7)
    items = [(i, prose(500 + i, r.randrange(4, 40), 60)) for i in range(14)] + [(14, "one two"), (15, "solo"), (16, None), (17, ""), (18, prose(500, 20, 60)), (19, "a b c a b c a b c a b c")]
    docs = []
    for i in range(50):
        t = prose(r.randrange(10**6), r.randrange(0, 60), 60)
        if r.random() < 0.6:
            w = (items[r.randrange(14)][1] or "").split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = "changed"
            t += " " + " ".join(w).upper() + " " + prose(r.randrange(10**6), 20, 60)
        docs.append((i, t))
    docs += [(50, None), (51, ""), (52, "Solo!"), (53, "x one, two y"), (None, items[0][1]), (54, prose(9, 8000) + " " + items[3][1]), (55, items[5][1]), (55, items[5][1]), (56, "a b c"), (57, "a b c a b c")]
    want = brute(docs, items)
    assert len(want) > 20
    assert found(make(docs), benchmark(spark, items), limit=limit) == want
    kept = dc.drop_leaks(make(docs, {"item_id": "clash", "containment": "c"}), benchmark(spark, items), limit=limit)
    assert kept.columns[-2:] == ["item_id", "containment"]
    gone = {d for d, *_ in want}
    got = [x.doc_id for x in kept.collect() if x.doc_id is not None]
    assert sorted(got) == sorted(d for d, _ in docs if d is not None and d not in gone)


def test_empty(spark, make):
    assert found(make([]), benchmark(spark, [(1, "a b c d")])) == []
    assert found(make(["a b c d"]), benchmark(spark, [])) == []
    assert dc.drop_leaks(make(["a b c d"]), benchmark(spark, [])).count() == 1


def test_prefix_is_rarest_first():
    import numpy as np

    items = dc.Items([1], np.array([6]), np.array([0, 4]), np.array([10, 20, 30, 40], np.uint64))
    key, owner = dc.prefixes(items, (np.array([10, 20, 30], np.uint64), np.array([5, 1, 1])), 0.75)
    assert key.tolist() == [20, 40] and owner.tolist() == [0, 0]


def test_query_on_the_small_tables(spark):
    read = lambda n, k: [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/{n}.parquet").select(k, "text").collect()]
    assert sorted(tuple(r) for r in dc.op3_decontamination(spark, f"{DATA}/sf0.001").collect()) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_texts_of_one_id_and_one_length(spark, make):
    texts = [prose(70 + k, 40) for k in range(3)]
    benchmark = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])], "item_id long, text string")
    docs = make([f"{prose(90 + k, 60)} {t} {prose(95 + k, 60)}" for k, t in enumerate(texts)] + [prose(99, 200)])
    assert sorted((r.doc_id, r.item_id, r.containment) for r in dc.leaks(docs, benchmark).collect()) == [(k, 1, 1.0) for k in range(3)]
    assert [r.doc_id for r in dc.drop_leaks(docs, benchmark).collect()] == [3]


def test_short_items_are_found_anywhere(spark, make):
    items = [(1, "alpha beta"), (2, "solo"), (3, "Alpha, BETA!"), (4, "gamma delta epsilon")]
    docs = [(0, "alpha beta"), (1, "x alpha beta y alpha beta"), (2, "alpha x beta"), (3, "go solo now"), (4, "soloist"), (5, "x gamma delta epsilon"), (6, "beta alpha")]
    want = [(0, 1, 1.0, 0, 2), (0, 3, 1.0, 0, 2), (1, 1, 1.0, 1, 3), (1, 3, 1.0, 1, 3), (3, 2, 1.0, 1, 2), (5, 4, 1.0, 1, 4)]
    assert found(make(docs), benchmark(spark, items)) == want == brute(docs, items)
    assert sorted(r.doc_id for r in dc.drop_leaks(make(docs), benchmark(spark, items)).collect()) == [2, 4, 6]
    assert found(make(docs), benchmark(spark, items[:3])) == want[:5]


def test_sql_knows_short_items_and_signs(spark, make, tmp_path):
    import duckdb

    items = [(1, "alpha beta"), (2, "solo"), (3, prose(3, 12)), (4, "\u706f\u5854\u7684\u770b\u5b88\u4eba"), (5, "\u5854"), (6, None)]
    docs = [(0, "x alpha beta y alpha beta"), (1, "solo " + prose(3, 12)), (2, prose(9, 30)), (3, "a \u90a3\u5ea7\u706f\u5854\u7684\u770b\u5b88\u4eba\u8d70"), (4, None), (5, "")]
    make(docs).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in dc.op3_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(dc.sql()).fetchall()) and [(d, i) for d, i, *_ in got] == [(0, 1), (1, 2), (1, 3), (3, 4), (3, 5)]


def test_ids_of_any_type(spark, make):
    docs = make([(1, prose(1, 40)), (2, prose(2, 40))]).selectExpr("concat('d', doc_id) AS doc_id", "text", "lang AS `tick``s`")
    items = spark.createDataFrame([("i", prose(2, 20))], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()] == [("d2", "i")]
    assert [r["doc_id"] for r in dc.drop_leaks(docs, items).collect()] == ["d1"]
