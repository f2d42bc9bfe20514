import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import DATA, prose
from tracemill.llm import pfor, tokens

LISTS = st.lists(st.lists(st.one_of(st.integers(0, 7), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=300).map(lambda x: np.array(x, np.uint32)), min_size=1, max_size=5)


@given(LISTS, st.sampled_from([1, 8, 128, 256]), st.sampled_from([0.5, 0.9, 1.0]))
@settings(max_examples=120, deadline=None)
def test_round_trip(lists, block, percentile):
    blobs, starts = pfor.encode(lists, block, percentile)
    for x, b, s in zip(lists, blobs, starts):
        assert np.array_equal(pfor.decode(b, s), x)
        for k, at in enumerate(s):
            assert np.array_equal(pfor.decode_block(b, int(at)), x[k * block : (k + 1) * block])


def test_outliers_are_exceptions_and_the_width_is_the_percentiles():
    x = np.full(128, 1000, np.uint32)
    x[:64] += 3
    x[[5, 77]] = 2**31
    (blob,), (starts,) = pfor.encode([x])
    h = np.frombuffer(blob, pfor.HEAD, 1)[0]
    assert (h["minimum"], h["width"], h["exceptions"], h["last"]) == (1000, 2, 2, 127)
    assert len(blob) == pfor.HEAD.itemsize + 32 + 2 * 5 and starts.tolist() == [0]


def test_ids_take_fewer_bytes_than_whole_numbers():
    ids = tokens.ids(prose(1, 5000))
    (blob,), _ = pfor.encode([ids])
    assert len(blob) < 2.2 * len(ids)


def test_documents(make):
    docs = [(1, prose(1, 400)), (2, None), (3, ""), (None, prose(2, 10)), (4, prose(3, 40_000)), (5, "twice"), (5, "twice")]
    rows = pfor.to_blocks(make(docs, {"blob": "clash"})).collect()
    assert len(rows) == 7
    text = {d: t for d, t in docs}
    for r in rows:
        assert pfor.decode(r.blob, r.block_starts).tolist() == tokens.ids(text[r.doc_id]).tolist()
        assert r.n_tokens == len(tokens.ids(text[r.doc_id])) and len(r.block_starts) == -(-r.n_tokens // pfor.BLOCK)
    assert pfor.to_blocks(make([])).collect() == []


def test_query_on_the_small_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = pfor.op6_pfor(spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert np.array_equal(pfor.decode(r.blob, r.block_starts), tokens.ids(docs[r.doc_id]))


def test_ids_of_any_type(make):
    rows = pfor.to_blocks(make(["one two three"]).selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()
    assert [(r.doc_id, pfor.decode(r.blob, r.block_starts).tolist()) for r in rows] == [("d0", tokens.ids("one two three").tolist())]
