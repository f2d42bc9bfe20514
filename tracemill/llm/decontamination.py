"""Benchmark decontamination by a prefix-filtered set join.

A document is contaminated by an item when some window of the document, as long
as the item, holds THRESHOLD of the item's distinct word shingles.

1. Shingles: SHINGLE words, lower case, letters and digits, each Chinese or
   Japanese sign for itself; an item of fewer words is one shingle of all its
   words, and is held by every document with these words in a row.
2. Rarity: in how many documents of the whole corpus each shingle of the
   benchmark occurs.  Shingles are ordered by it, rarest first, ties by hash.
3. Prefix: a window that holds need = ceil(THRESHOLD * size) of an item's
   shingles holds one of its size - need + 1 rarest.  Only those are joined
   with the documents: a document without any is out after one lookup.
4. Bounds: a document of fewer shingles than need is out; and by position, a
   prefix shingle at p of the document allows only windows that cover p.
5. Verification: exact count of the item's distinct shingles in each window
   that step 4 leaves.

The benchmark doesn't grow with the corpus, but that isn't taken for granted:
its shingles are counted first, and items are joined in slices of at most
SLICE_SHINGLES shingles, each small enough to be sent to the executors.  A
benchmark beyond one slice takes further passes over the documents and nothing
is left out.  Documents are never shuffled.

Defined cases: null or wordless texts, and null item texts, match nothing; null
ids are skipped by `leaks`, ids may be of any type; an item that occurs twice is reported under both ids; of
several equally good windows the first is reported; very long texts are scanned
whole; empty tables give no rows; further columns are kept by `drop_leaks`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracemill.llm import textkit as tk
from tracemill.llm.cluster import prepare
from tracemill.llm.columns import identified, quoted

SHINGLE = 3
THRESHOLD = 0.7
#: Shingles of the benchmark that are sent to the executors at a time (16 bytes each).
SLICE_SHINGLES = 1_000_000


@dataclass
class Items:
    """A slice of the benchmark. Shingles are listed item by item, sorted; `first` bounds them."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    shingle: np.ndarray

    def needs(self, threshold: float) -> np.ndarray:
        return np.ceil(np.diff(self.first) * threshold - 1e-9).astype(np.int64)


    def short(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length below SHINGLE of items: (shingles, sorted, item numbers)."""
        out = {}
        for k in range(1, SHINGLE):
            i = np.flatnonzero(self.words == k)
            if len(i):
                h = self.shingle[self.first[i]]
                order = np.argsort(h, kind="stable")
                out[k] = (h[order], i[order])
        return out

    def long(self) -> np.ndarray:
        """The numbers of the items of SHINGLE words and more."""
        return np.flatnonzero(self.words >= SHINGLE)


def _lower(docs: DataFrame, key: str) -> DataFrame:
    text = quoted("text").cast("string")
    return docs.select(identified(docs, key)[0].alias(key), F.lower(text).alias("text")).filter(f"{key} IS NOT NULL AND text IS NOT NULL")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tk.chunks(batch.column(1)):
            w = tk.Words(data, off, tk.ALNUM, dense=True)
            row, h = w.shingles(SHINGLE)
            same = tk.span_hash(w.hash, w.first[:-1], w.first[1:], 1).view(np.int64)
            pairs = np.unique(np.rec.fromarrays([row, h], names="row,h"))
            ids = batch.column(0).slice(a, b - a).take(pa.array(pairs.row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.first)[pairs.row]), pa.array(np.ascontiguousarray(pairs.h).view(np.int64)), pa.array(same[pairs.row])], ["item_id", "words", "shingle", "same"])


def slices(benchmark: DataFrame, limit: int = SLICE_SHINGLES) -> Iterator[Items]:
    """The benchmark in pieces of at most `limit` shingles, an item at least."""
    rows = _lower(benchmark, "item_id").mapInArrow(_shingled, f"item_id {identified(benchmark, 'item_id')[1]}, words long, shingle long, same long")
    # Text that repeats under one id counts once a text: a hash of the words tells the texts of an id apart.
    listed = rows.groupBy("item_id", "words", "same").agg(F.collect_set("shingle").alias("shingles")).orderBy("item_id", "words", "same")
    ids, words, shingles, held = [], [], [], 0

    def made() -> Items:
        return Items(list(ids), np.array(words, np.int64), np.cumsum([0, *map(len, shingles)]), np.concatenate(shingles))

    for r in listed.toLocalIterator():
        if ids and held + len(r.shingles) > limit:
            yield made()
            ids, words, shingles, held = [], [], [], 0
        ids.append(r.item_id)
        words.append(r.words)
        shingles.append(np.sort(np.array(r.shingles, np.int64).view(np.uint64)))
        held += len(r.shingles)
    if ids:
        yield made()


def find(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are keys, their places among the keys)."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == values)
    return hit, at[hit]


class Screen:
    """Which of a fixed set of keys occur among many values: a bitmap of key hashes goes before the search."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.keys >> tk.U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        likely = np.flatnonzero(self.seen[(values >> tk.U(64 - self.BITS)).astype(np.int64)])
        hit, at = find(self.keys, values[likely])
        return likely[hit], at


def _frequency(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value)
        total = np.zeros(len(screen.keys), np.int64)
        for batch in batches:
            for _, _, data, off in tk.chunks(batch.column(1)):
                row, h = tk.Words(data, off, tk.ALNUM, dense=True).shingles(SHINGLE)
                hit, at = screen.find(h)
                once = np.unique(row[hit] * len(total) + at) % max(1, len(total))
                total += np.bincount(once, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(screen.keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    return count


def prefixes(items: Items, counted: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, item number) of each item's necessary prefix, sorted by shingle. counted: shingles, sorted, and their documents."""
    n = np.zeros(len(items.shingle), np.int64)
    hit, at = find(counted[0], items.shingle)
    n[hit] = counted[1][at]
    need = items.needs(threshold)
    keys, owners = [], []
    for i in items.long():
        a, b = items.first[i], items.first[i + 1]
        order = np.lexsort([items.shingle[a:b], n[a:b]])[: b - a - need[i] + 1]
        keys.append(items.shingle[a:b][order])
        owners.append(np.full(len(order), i))
    k, o = np.concatenate([np.zeros(0, tk.U), *keys]), np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.lexsort([o, k])
    return k[order], o[order]


def best_window(position: np.ndarray, which: np.ndarray, near: np.ndarray, width: int) -> tuple[int, int]:
    """(most distinct `which` within `width` positions, first such window's start), over windows that cover one of `near`.

    position is sorted.  The best window may be taken to start at a hit.
    """
    best, start = 0, 0
    for k, p in enumerate(position):
        j = np.searchsorted(near, p)
        if j == len(near) or near[j] >= p + width:
            continue
        n = len(np.unique(which[k : np.searchsorted(position, p + width)]))
        if n > best:
            best, start = n, int(p)
    return best, start


def _short(words: tk.Words, k: int, key: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, item number, first word) of the first of each item of k words in each row that holds it."""
    at, h = words.windows(k)
    likely, _ = find(np.unique(key), h)
    lo, hi = np.searchsorted(key, h[likely]), np.searchsorted(key, h[likely], "right")
    seen = set()
    for p, a, b in zip(at[likely], lo, hi):
        r = int(words.row[p])
        for i in item[a:b]:
            if (r, i) not in seen:
                seen.add((r, i))
                yield r, int(i), int(p - words.first[r])


def _matches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, key, owner, threshold = shared.value
        screen = Screen(key)
        bound = np.searchsorted(key, screen.keys), np.searchsorted(key, screen.keys, "right")
        need, size, short = items.needs(threshold), np.diff(items.first), items.short()
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0)
            for a, _, data, off in tk.chunks(batch.column(1)):
                w = tk.Words(data, off, tk.ALNUM, dense=True)
                for k, (key_k, item_k) in short.items():
                    out += [(ids[a + r].as_py(), items.ids[i], 1.0, p, p + k) for r, i, p in _short(w, k, key_k, item_k)]
                first, h = w.windows(SHINGLE)
                row = w.row[first]
                hit, at = screen.find(h)
                if not len(hit):
                    continue
                edge = np.searchsorted(row, np.arange(w.rows + 1))
                have = np.diff(edge)
                times = bound[1][at] - bound[0][at]
                item = owner[np.repeat(bound[0][at] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                where = np.repeat(hit, times)
                long = have[row[where]] >= need[item]
                item, where = item[long], where[long]
                order = np.lexsort([where, item, row[where]])
                item, where = item[order], where[order]
                cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[where[1:]] != row[where[:-1]]), [True]])) if len(item) else np.zeros(1, np.int64)
                for s, e in zip(cut[:-1], cut[1:]):
                    i, r = item[s], row[where[s]]
                    width = max(1, int(items.words[i]) - SHINGLE + 1)
                    near = where[s:e] - edge[r]
                    lo, hi = edge[r] + max(0, near[0] - width + 1), min(edge[r + 1], edge[r] + near[-1] + width)
                    mine = items.shingle[items.first[i] : items.first[i + 1]]
                    found, which = find(mine, h[lo:hi])
                    if len(found) < need[i]:
                        continue
                    n, start = best_window(found + lo - edge[r], which, near, width)
                    if n >= need[i]:
                        out.append((ids[a + int(r)].as_py(), items.ids[i], round(n / int(size[i]), 6), start, start + int(items.words[i])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "containment", "first_word", "end_word"), x)) for x in out])

    return match


def document_frequency(text: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The items' shingles that occur, sorted, and the number of documents of each: no more rows than the slice has."""
    long = items.words >= SHINGLE
    if not long.any():
        return np.zeros(0, tk.U), np.zeros(0, np.int64)
    shared = text.sparkSession.sparkContext.broadcast(np.unique(items.shingle[np.repeat(long, np.diff(items.first))]))
    t = text.mapInArrow(_frequency(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    key, n = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = SLICE_SHINGLES) -> DataFrame:
    """doc_id, item_id, containment and the window [first_word, end_word) for each document that holds an item."""
    spark = prepare(docs.sparkSession)
    text = _lower(docs, "doc_id")
    schema = f"doc_id {identified(docs, 'doc_id')[1]}, item_id {identified(benchmark, 'item_id')[1]}, containment double, first_word long, end_word long"
    found = None
    for items in slices(benchmark, limit):
        key, owner = prefixes(items, document_frequency(text, items), threshold)
        part = text.mapInArrow(_matches(spark.sparkContext.broadcast((items, key, owner, threshold))), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found


def _any_leak(shared):
    match = _matches(shared)

    def flag(doc_text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(doc_text))), doc_text], ["doc_id", "text"])
        bad = np.zeros(len(doc_text), bool)
        for b in match(iter([batch])):
            bad[b.column(0).to_numpy()] = True
        return pa.array(bad)

    return F.arrow_udf(flag, BooleanType())


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = SLICE_SHINGLES) -> DataFrame:
    """docs without those that hold an item; all columns stay, and no document is moved."""
    spark = prepare(docs.sparkSession)
    text = docs.select(F.lit(0).alias("doc_id"), F.lower(quoted("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    kept = docs
    for items in slices(benchmark, limit):
        key, owner = prefixes(items, document_frequency(text, items), threshold)
        udf = _any_leak(spark.sparkContext.broadcast((items, key, owner, threshold)))
        kept = kept.filter(~udf(F.lower(F.coalesce(quoted("text").cast("string"), F.lit("")))))
    return kept


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sql(threshold: float = THRESHOLD, n: int = SHINGLE) -> str:
    """The leaks of benchmark into documents in DuckDB's SQL."""
    words = r"regexp_extract_all(lower(text), '[\x{3000}-\x{9FFF}]|[a-z0-9\x{80}-\x{2FFF}\x{A000}-\x{10FFFF}]+')"
    shingles = f"CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE [] END"
    runs = " UNION ALL ".join(f"SELECT doc_id, {k} AS words, array_to_string(w[p + 1:p + {k}], ' ') AS phrase, p FROM places WHERE p + {k} <= len(w)" for k in range(1, n))
    return f"""
WITH item_words AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
doc_words AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT item_id, len(w) AS words, list_distinct({shingles}) AS s FROM item_words),
item_shingles AS (SELECT item_id, words, len(s) AS size, unnest(s) AS shingle FROM items),
doc_lists AS (SELECT doc_id, {shingles} AS s FROM doc_words),
doc_shingles AS (SELECT doc_id, unnest(s) AS shingle, unnest(range(len(s))) AS p FROM doc_lists),
hits AS (SELECT doc_id, item_id, words, size, shingle, p FROM doc_shingles JOIN item_shingles USING (shingle)),
windows AS (SELECT a.doc_id, a.item_id, a.words, a.size, a.p, count(DISTINCT b.shingle) AS k FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.words - {n} GROUP BY ALL),
best AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k DESC, p) = 1),
short AS (SELECT DISTINCT item_id, len(w) AS words, array_to_string(w, ' ') AS phrase FROM item_words WHERE len(w) BETWEEN 1 AND {n - 1}),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM doc_words WHERE EXISTS (SELECT 1 FROM short)),
runs AS ({runs}),
shorts AS (SELECT doc_id, item_id, words, min(p) AS p FROM runs JOIN short USING (words, phrase) GROUP BY doc_id, item_id, words, phrase)
SELECT doc_id, item_id, round(k / size, 6) AS containment, p AS first_word, p + words AS end_word FROM best WHERE k >= {threshold} * size - 1e-9
UNION ALL SELECT doc_id, item_id, 1.0::DOUBLE AS containment, p AS first_word, p + words AS end_word FROM shorts
"""
