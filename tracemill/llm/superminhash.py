"""Near-duplicate groups by SuperMinHash signatures.

SuperMinHash (O. Ertl, 2017) draws for each element a random permutation of the
M signature positions and gives the element the value j + r_j at the position
that the permutation has j-th, r_j uniform in [0, 1).  The ranks of one element
are correlated, which lowers the variance of the Jaccard estimate below that of
M independent hash functions; and as later ranks are larger, a document stops
as soon as its largest signature value is below the next rank - after two or
three ranks for a usual text.  Here the ranks of all elements of many documents
are drawn together, as arrays.

1. words: lower case, letters and digits, each Chinese or Japanese sign for
   itself; elements: SHINGLE words.
2. Documents of the same words are one representative with its copies; what
   follows goes over representatives.
3. BANDS bands of ROWS signature values; documents that share a band's hash are
   a bucket.  Buckets of the same members, as copies make in many bands, are
   looked at once.
4. verification: in a bucket, the share of equal signature values, corrected for
   the chance that one-byte values agree, estimates the similarity.  From
   THRESHOLD + MARGIN a pair is verified: a walk compares each member with those
   that no group of the bucket has yet, so a bucket of n near copies costs about
   n comparisons.  Pairs between these groups within MARGIN of THRESHOLD are
   decided by their exact sets of elements.  MARGIN is three deviations.  A
   bucket of more than PART members is looked at by pairs of its parts, each
   pair in a task of its own: no member and no pair is left out.
5. Verified pairs are united (components.py); a group keeps its least doc_id.

A row is what stays or goes.  It is known by its place in the sketches, which
are written once, and found again in the documents by doc_id and a hash of its
text; only rows that may have to go are moved for that (sieve.py), and the
texts of undecided pairs.

Nothing is capped.  Defined cases: null or wordless texts and null doc_ids are
in no group and stay; a text of 1 to SHINGLE - 1 words is one element; very
long texts are taken whole; rows of one doc_id with different texts are
different documents; of rows that repeat doc_id and text one stays; ids may be
of any type; an empty table gives no groups; further columns of any name are
kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import textkit as tk
from tracemill.llm.cluster import prepare, settle
from tracemill.llm.columns import fresh, identified, own, quoted
from tracemill.llm.components import components
from tracemill.llm.sieve import sieve

SHINGLE = 3
M, BANDS, ROWS = 128, 42, 3
THRESHOLD, MARGIN = 0.5, 0.13
#: Elements whose permutations are held at once (M bytes each).
BLOCK = 1 << 17
#: Members of a bucket that are compared in one place.
PART = 4096

_EMPTY = np.iinfo(np.uint64).max
_RANK = tk.U(40)


def signatures(row: np.ndarray, element: np.ndarray, rows: int, m: int = M) -> np.ndarray:
    """rows x m SuperMinHash values (rank in the high bits, fraction in the low 40); _EMPTY for rows without elements.

    Elements are taken BLOCK at a time, each with its permutation; what a
    document's earlier elements gave lets its later ones stop sooner.
    """
    sig = np.full(rows * m, _EMPTY, np.uint64)
    place = np.empty((min(len(element), BLOCK), m), np.uint8 if m <= 256 else np.uint16)
    for a in range(0, len(element), BLOCK):
        e, base = element[a : a + BLOCK], row[a : a + BLOCK] * m
        place[:] = np.arange(m, dtype=place.dtype)
        at = np.arange(len(e))
        for j in range(m):
            x = tk.mix(e[at] + tk.U((j + 1) * int(tk.GOLD) % 2**64))
            k = (((x >> tk.U(32)) * tk.U(m - j)) >> tk.U(32)).astype(np.int64) + j
            to = place[at, k]
            place[at, k] = place[at, j]
            value = (tk.U(j) << _RANK) | ((x * tk.GOLD) >> tk.U(24))
            np.minimum.at(sig, base[at] + to, value)
            done = sig.reshape(rows, m).max(1) < (j + 1) << 40
            at = at[~done[base[at] // m]]
            if not len(at):
                break
    return sig.reshape(rows, m)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tk.chunks(batch.column(2), 1 << 19):
            w = tk.Words(data, off, tk.ALNUM, dense=True)
            some = np.flatnonzero(np.diff(w.first) > 0)
            if not len(some):
                continue
            row, element = w.shingles(SHINGLE)
            sig = signatures(row, element, w.rows)[some]
            first, last = w.first[some], w.first[some + 1]
            same = [tk.span_hash(w.hash, first, last, which).view(np.int64) for which in (1, 2)]
            band = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                band = tk.mix(band * tk.GOLD + sig[:, r : BANDS * ROWS : ROWS] + np.arange(BANDS, dtype=np.uint64))
            low = tk.mix(sig).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(a, b - a).take(pa.array(some)) for c in (0, 1)),
                pa.array(same[0]), pa.array(same[1]),
                pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, (len(some) + 1) * M, M, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(low))]),
            ], ["doc_id", "key", "same1", "same2", "bands", "sketch"])


def _key() -> Column:
    """With the doc_id, what a row of the documents is found by."""
    return F.xxhash64(quoted("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    text = quoted("text").cast("string")
    return docs.select(identified(docs, "doc_id")[0].alias("doc_id"), _key().alias("key"), F.lower(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def sketches(docs: DataFrame) -> DataFrame:
    return _texts(docs).mapInArrow(_sketch, f"doc_id {identified(docs, 'doc_id')[1]}, key long, same1 long, same2 long, bands array<long>, sketch binary")


def _runs(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a sorted input, cut anew so that no run of the first column's values is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(_runs(key)[-2])
        if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (band, node) -> (bucket, node) of buckets of two and more; bucket: a hash of the members.

    A bucket of more than PART nodes is given out as the pairs of its parts.
    """
    for t in whole_runs(batches):
        band, node = t.column(0).to_numpy(), t.column(1).to_numpy()
        bound = _runs(band)
        size = np.diff(bound)
        many = np.repeat((size > 1) & (size <= PART), size)
        name = tk.mix(np.add.reduceat(tk.mix(node.view(tk.U) + tk.GOLD), bound[:-1]) + size.astype(tk.U))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[many].view(np.int64)), pa.array(node[many])], ["bucket", "node"])
        for k in np.flatnonzero(size > PART):
            nodes = np.sort(node[bound[k] : bound[k + 1]])
            parts = [nodes[i : i + PART] for i in range(0, len(nodes), PART)]
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    both = np.concatenate([parts[i], parts[j]])
                    key = tk.mix(np.add.reduce(tk.mix(both.view(tk.U) + tk.GOLD), keepdims=True) + tk.U(len(both))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, len(both))), pa.array(both)], ["bucket", "node"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from one-byte signature values."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def unite(doc: np.ndarray, sketch: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its group) for the groups of one bucket, least members left out."""
    order = np.argsort(doc, kind="stable")
    doc, sketch = doc[order], sketch[order]
    rest = np.arange(len(doc))
    members, roots = [], []
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = agreement(sketch[rest], sketch[todo.pop()]) >= threshold
            found = rest[near]
            if len(found):
                rest = rest[~near]
                members.append(found)
                roots.append(np.full(len(found), root))
                todo.extend(found)
    if not members:
        return doc[:0], doc[:0]
    return doc[np.concatenate(members)], doc[np.concatenate(roots)]


def _unsure(doc: np.ndarray, sketch: np.ndarray, sure: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that the estimate doesn't decide, between different groups of the sure."""
    member, root = sure
    group = doc.copy()
    if len(member):
        order = np.argsort(member, kind="stable")
        at = np.minimum(np.searchsorted(member[order], doc), len(member) - 1)
        group = np.where(member[order][at] == doc, root[order][at], doc)
    u, v = [doc[:0]], [doc[:0]]
    for i in range(len(doc) - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if len(rest):
            near = agreement(sketch[rest], sketch[i])
            near = rest[(near >= THRESHOLD - MARGIN) & (near < THRESHOLD + MARGIN)]
            u.append(np.maximum(doc[near], doc[i]))
            v.append(np.minimum(doc[near], doc[i]))
    return np.concatenate(u), np.concatenate(v)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_runs(batches):
        bucket, doc = t.column(0).to_numpy(), t.column(1).to_numpy()
        sketch = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(doc), -1)
        bound = _runs(bucket)
        pair = np.flatnonzero(np.diff(bound) == 2)
        i = bound[pair]
        near = agreement(sketch[i], sketch[i + 1])
        hi, lo = np.maximum(doc[i], doc[i + 1]), np.minimum(doc[i], doc[i + 1])
        good = near >= THRESHOLD + MARGIN
        maybe = ~good & (near >= THRESHOLD - MARGIN)
        found = {True: ([hi[good]], [lo[good]]), False: ([hi[maybe]], [lo[maybe]])}
        for k in np.flatnonzero(np.diff(bound) > 2):
            a, b = bound[k], bound[k + 1]
            sure = unite(doc[a:b], sketch[a:b], THRESHOLD + MARGIN)
            for key, (x, y) in ((True, sure), (False, _unsure(doc[a:b], sketch[a:b], sure))):
                found[key][0].append(x)
                found[key][1].append(y)
        for key, (u, v) in found.items():
            u, v = np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), key))], ["u", "v", "sure"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct elements of each text, sorted."""
    for batch in batches:
        for a, b, data, off in tk.chunks(batch.column(1)):
            row, h = tk.Words(data, off, tk.ALNUM, dense=True).shingles(SHINGLE)
            pairs = np.unique(np.rec.fromarrays([row, h], names="row,h"))
            first = np.searchsorted(pairs.row, np.arange(b - a + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(first), pa.array(np.ascontiguousarray(pairs.h).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["node", "elements"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v, elements of u, elements of v) of at least THRESHOLD."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = both >= THRESHOLD * (len(x) + len(y) - both) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (0, 1)], ["u", "v"])


def verified(docs: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(u, v): the sure pairs, and the others that their elements confirm. first: (node, doc_id, key) of each representative."""
    pairs = settle(pairs.distinct())
    unsure = pairs.filter("NOT sure").select("u", "v")
    asked = settle(first.join(unsure.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node"))
    # Rows that repeat doc_id and text are taken once.
    texts = _texts(docs).filter(sieve(asked.select("key"))(F.col("key"))).groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    sets = settle(texts.join(asked, ["doc_id", "key"]).select("node", "text").mapInArrow(_elements, "node long, elements array<long>"))
    both = unsure.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("elements").alias("y")), "v")
    return pairs.filter("sure").select("u", "v").union(both.select("u", "v", "x", "y").mapInArrow(_exact, "u long, v long"))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, key, group_id, keep, links): a row for each row of docs in a group of two and more."""
    prepare(docs.sparkSession)
    sketched = settle(sketches(docs).withColumn("node", F.monotonically_increasing_id()))
    # Representatives: one row of each sequence of words.
    alike = settle(sketched.groupBy("same1", "same2").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n")))
    alike = alike.select("same1", "same2", "n", F.col("first.node").alias("node"), F.col("first.doc_id").alias("least"))
    first = sketched.join(alike.select("node"), "node", "left_semi")
    bands = first.select(F.explode("bands").alias("band"), "node").repartition("band").sortWithinPartitions("band")
    buckets = bands.mapInArrow(_buckets, "bucket long, node long").distinct()
    pairs = buckets.join(first.select("node", "sketch"), "node").select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify, "u long, v long, sure boolean")
    joined = components(verified(docs, pairs, first.select("node", "doc_id", "key")))
    star = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    placed = alike.join(star, "node", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct("least", "node")).alias("k"))
    named = placed.select("same1", "same2", "root").join(kept, "root").select("same1", "same2", F.col("k.least").alias("group_id"), F.col("k.node").alias("stays"), (F.col("size") - 1).alias("links"))
    return sketched.select("doc_id", "key", "node", "same1", "same2").join(named, ["same1", "same2"]).select("doc_id", "key", "group_id", (F.col("node") == F.col("stays")).alias("keep"), "links")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep, links) for each row of a group of two and more.

    group_id: the group's least doc_id, whose row is the one to keep; links: the
    rows that it is linked to, directly or through others.
    """
    return members(docs).drop("key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose group keeps another one."""
    rows = members(docs).groupBy("doc_id", "key").agg(F.max("keep").alias("some"), F.count("*").alias("n")).filter("NOT some OR n > 1")
    decided = settle(rows.select("doc_id", "key", "some"))
    i, k = fresh(docs, "doc_id_as_text", "key")
    marked = docs.select(*own(docs), identified(docs, "doc_id")[0].alias(i), _key().alias(k))
    maybe = sieve(decided.select("key"))(F.col(k))
    moved, named = marked.filter(maybe), decided.withColumnsRenamed({"doc_id": i, "key": k})
    out = marked.filter(~maybe).union(moved.join(named, [i, k], "left_anti").select(*own(marked)))
    if not (once := named.filter("some")).isEmpty():
        out = out.union(moved.join(once, [i, k], "left_semi").dropDuplicates([i, k]).select(*own(marked)))
    return out.select(*own(docs))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
