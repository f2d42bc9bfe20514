from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import DATA, prose
from tracemill.llm import packing, tokens


@given(st.integers(0, 10**6), st.integers(0, 12))
def test_decomposition(n, largest):
    parts = packing.decompose(n, largest)
    assert sum(1 << b for b in parts) == n
    assert parts == sorted(parts, reverse=True)
    below = [b for b in parts if b < largest]
    assert len(set(below)) == len(below) and max(parts, default=0) <= largest


def check(rows, docs, largest=packing.LARGEST, batch=packing.BATCH_TOKENS):
    """Pieces put together again are the documents; batches are of one bucket and no larger than they may be."""
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.tokens) == r.n_tokens == 1 << r.bucket
        pieces[r.doc_id].append(r)
        batches[r.batch].append(r)
    want = defaultdict(list)
    for i, t in docs:
        want[i] += tokens.ids(t).tolist()
    for i, t in want.items():
        got = sorted(pieces.pop(i, []), key=lambda r: (r.first_token, r.piece))
        if len({(r.first_token) for r in got}) == len(got):
            assert [x for r in got for x in r.tokens] == t
    assert not pieces
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1
        assert len(b) <= max(1, batch >> b[0].bucket)


def test_pieces_make_up_the_documents(make):
    docs = [(i, prose(i, n)) for i, n in enumerate([0, 1, 2, 3, 7, 50, 511, 512, 513, 4000])]
    docs += [(20, None), (21, ""), (22, "<|endoftext|> ünïcødé 日本"), (None, prose(7, 30)), (23, prose(8, 60_000))]
    check(packing.pack(make(docs, {"batch": "clash", "tokens": "x"})).collect(), docs)
    small = packing.pack(make(docs), largest=3, batch_tokens=16).collect()
    check(small, docs, 3, 16)
    assert max(r.bucket for r in small) == 3


def test_repeated_rows_are_each_packed(make):
    rows = packing.pack(make([(1, "one two three"), (1, "one two three")])).collect()
    assert sum(r.n_tokens for r in rows) == 2 * len(tokens.ids("one two three"))


def test_empty(make):
    assert packing.pack(make([])).collect() == []


def test_long_texts_have_the_ids_of_the_whole_text(monkeypatch):
    text = prose(3, 3000) + "\n\n  spaced   out 12 345 " + "z" * 500
    whole = tokens.ids(text).tolist()
    monkeypatch.setattr(tokens, "PIECE", 200)
    assert tokens.ids(text).tolist() == whole == tokens.encoding().encode_ordinary(text)


def test_query_on_the_small_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op9_packing(spark, f"{DATA}/sf0.001").collect(), docs)


def test_ids_of_any_type(make):
    rows = packing.pack(make(["one two three", "four"]).selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()
    assert {r.doc_id for r in rows} == {"d0", "d1"}
