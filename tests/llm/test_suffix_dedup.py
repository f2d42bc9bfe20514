import random
from collections import defaultdict

import pyarrow as pa
import pytest

from tests.llm.conftest import DATA, prose
from tracemill.llm import suffix_dedup as sd


def brute(docs, depth):
    seen, marks = defaultdict(list), defaultdict(set)
    for i, t in docs:
        if i is None or t is None:
            continue
        w = t.split()
        for a in range(len(w) - depth + 1):
            seen[tuple(w[a : a + depth])].append(((i, t), a))
    for v in seen.values():
        if len(v) > 1:
            for i, a in v:
                marks[i].update(range(a, a + depth))
    out = []
    for (i, _), m in marks.items():
        # Spans that touch are one.
        m = sorted(m)
        start = m[0]
        for x, y in zip(m, [*m[1:], None]):
            if y != x + 1:
                out.append((i, start, x + 1))
                start = y
    return sorted(out)


def found(df, depth, gram=sd.GRAM):
    return sorted(tuple(r) for r in sd.repeated_spans(df, depth, gram).collect())


def mixed(seed):
    r = random.Random(seed)
    docs = []
    for i in range(60):
        t = prose(r.randrange(25), r.randrange(0, 160))
        if r.random() < 0.4:
            t = t + " " + prose(1000 + r.randrange(5), 70) + " " + prose(r.randrange(10**6), 20)
        docs.append((i, t))
    return docs + [(60, "a b " * 100), (61, "x " * 300), (62, None), (63, ""), (None, prose(1, 90)), (64, prose(3, 9000)), (65, prose(3, 9000)), (65, prose(3, 9000))]


CASES = [(2, 1), (5, 3), (8, 16), (50, 16)]


@pytest.mark.parametrize("depth,gram", CASES)
def test_as_brute_force(make, depth, gram):
    docs = mixed(depth)
    assert found(make(docs), depth, gram) == brute(docs, depth)


@pytest.mark.parametrize("depth,gram", CASES)
@pytest.mark.parametrize("piece", [1, 700, 1 << 20])
@pytest.mark.parametrize("batch", [3, 1000])
def test_pieces_of_any_size(monkeypatch, depth, gram, piece, batch):
    """The passes by hand, over input cut so that repeats are within pieces or among them."""
    chunks = sd.tk.chunks
    monkeypatch.setattr(sd.tk, "chunks", lambda c: chunks(c, piece))
    docs = [(i, t) for i, t in mixed(depth + 1) if i is not None and t is not None]
    monkeypatch.setattr(sd, "BATCH_BYTES", 1)
    assert by_hand(docs, depth, gram, batch) == marked(docs, depth)


@pytest.mark.parametrize("depth,gram", CASES)
@pytest.mark.parametrize("bits", [0, 3])
def test_windows_with_equal_hashes_are_told_apart(monkeypatch, depth, gram, bits):
    """All words, digits and partitions have one hash, or one of eight: what is found stays exact."""
    weak = lambda x: x & sd.tk.U((1 << bits) - 1)
    words, spans, groups = sd.tk.Words._hashes, sd.tk.span_hash, sd.radix_groups
    monkeypatch.setattr(sd.tk.Words, "_hashes", lambda self: weak(words(self)))
    monkeypatch.setattr(sd.tk, "mix", lambda x, f=sd.tk.mix: weak(f(x)))
    monkeypatch.setattr(sd.tk, "span_hash", lambda *a: weak(spans(*a)))
    monkeypatch.setattr(sd, "radix_groups", groups)
    docs = [(i, t) for i, t in mixed(depth + 2) if i is not None and t is not None and len(t) < 3000]
    assert by_hand(docs, depth, gram, 100) == marked(docs, depth)


def by_hand(docs, depth, gram, batch):
    keys = {t: k for k, (_, t) in enumerate(docs)}
    table = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs], "text_key": pa.array([keys[t] for _, t in docs], pa.int64())})
    rows = pa.Table.from_batches(list(sd._digits(depth, min(gram, depth))(iter(table.to_batches(7))))).sort_by("digit").combine_chunks()
    marks = defaultdict(set)
    for b in sd._repeated(depth)(iter(rows.to_batches(batch))):
        for i, _, s, e in zip(*(c.to_pylist() for c in b.columns)):
            marks[i].update(range(s, e))
    return marks


def marked(docs, depth):
    want = defaultdict(set)
    for i, s, e in brute(docs, depth):
        want[i].update(range(s, e))
    return want


def test_passage_of_fifty_words_and_clean_documents(make):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(1, prose(1, 100) + " " + passage + " " + prose(2, 100)), (2, passage), (3, prose(4, 500)), (4, " ".join(f"p{i}" for i in range(49)) + " end")]
    assert found(make(docs, {"digit": "clash", "rest": "x"}), 50) == [(1, 100, 150), (2, 0, 50)]


def test_empty(make):
    assert found(make([]), 50) == []


def test_texts_of_one_id_have_spans_of_their_own(make, spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = [(1, a), (1, b + " tail"), (2, a), (3, b)]
    assert found(make(docs), 50) == brute(docs, 50) == [(1, 0, 60), (1, 0, 60), (2, 0, 60), (3, 0, 60)]
    ids = make(docs).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert found(ids, 50) == [("d1", 0, 60), ("d1", 0, 60), ("d2", 0, 60), ("d3", 0, 60)]


def test_white_space_between_words_does_not_count(make):
    w = prose(5, 70).split()
    assert found(make([(1, " ".join(w)), (2, "\n\t ".join(w) + "\n")]), 50) == [(1, 0, 70), (2, 0, 70)]


def test_passes_cover_the_window():
    for depth in (1, 2, 5, 50, 64):
        for first in (1, 16):
            p = sd.passes(depth, min(first, depth))
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) == depth


def test_query_on_the_small_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in sd.op1_suffix_dedup(spark, f"{DATA}/sf0.001").collect()) == brute(docs, sd.THRESHOLD)
