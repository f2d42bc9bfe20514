import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import textkit as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é.\n", max_size=40)), max_size=8)


def all_words(texts, kind, limit):
    out = []
    for a, _, data, off in tk.chunks(pa.array(texts, pa.string()), limit):
        w = tk.Words(data, off, kind)
        out += [(a + int(r), bytes(data[s:e]).decode(errors="replace")) for r, s, e in zip(w.row, w.start, w.end)]
    return out


@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_split(texts, limit):
    assert all_words(texts, tk.RAW_WORD, limit) == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


@given(TEXTS, st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_equal_windows_hash_alike_and_others_differ(texts, k):
    seen, n = {}, 0
    for _, _, data, off in tk.chunks(pa.array(texts, pa.string())):
        w = tk.Words(data, off)
        at, h = w.windows(k)
        for i, x in zip(at, h):
            words = tuple(bytes(data[s:e]) for s, e in zip(w.start[i : i + k], w.end[i : i + k]))
            assert seen.setdefault(words, x) == x
            n += 1
    assert len(set(map(int, seen.values()))) == len(seen)
    assert n == sum(max(0, len((t or "").split()) - k + 1) for t in texts)


def test_long_texts_hash_in_pieces(monkeypatch):
    data, off = tk.buffers(pa.array(["alpha beta gamma " * 50, "x" * 500 + " delta"]))
    whole = tk.Words(data, off).hash
    monkeypatch.setattr(tk, "CHUNK_BYTES", 8)
    assert np.array_equal(tk.Words(data, off).hash, whole)


def test_slices_and_large_strings():
    a = pa.array(["x y", None, "z é", "y"])
    for column in (a.slice(1), a.cast(pa.large_string()).slice(1), pa.chunked_array([a.slice(1, 1), a.slice(2)])):
        raw, off = tk.buffers(column)
        assert [bytes(raw[s:e]).decode() for s, e in zip(off[:-1], off[1:])] == ["", "z é", "y"]


def test_hashes_agree_wherever_a_word_stands():
    one = tk.Words(*next(iter(tk.chunks(pa.array(["alpha"]))))[2:])
    far = tk.Words(*next(iter(tk.chunks(pa.array(["q " * 5000 + "alpha"]))))[2:])
    assert one.hash[0] == far.hash[-1]
    assert np.all(far.hash[:-1] == far.hash[0])
