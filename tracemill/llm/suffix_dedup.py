"""Repeated windows by a depth-limited radix sort of suffixes.

A suffix starts at each word of the corpus.  Only its first THRESHOLD words
count, so the suffixes are ordered by most-significant-digit passes over their
words that stop at that depth, and a pass goes on only inside groups that are
still together: what is alone in its group is not repeated and is left out at
once.  After the last pass the groups are exactly the repeated windows of
THRESHOLD words.

partition   Suffixes that can be equal have to meet in one task.  The least hash
            among a window's runs of GRAM words is a function of the window
            alone, so equal windows have it in common, and neighbouring suffixes
            share it, about 20 of them at a time: one row stands for such a run
            of suffixes and carries their words, as text.
passes      In each bucket the digits are the suffixes' first word, their second,
            their next two, four, eight and sixteen, and the rest up to the
            threshold (PASSES).  Digits are compared as hashes of their words.
last pass   What is still together is compared letter by letter, so hashes only
            decide what is looked at: no two different windows count as equal.

Windows that repeat within one piece of input are found there, by the same
passes, and only the first of them is sent, as reported: so what a task gets of a
passage grows with the pieces that hold it, not with its copies.  Groups of any
size are streamed, none is collected: of a bucket that goes on in the next
batch, one suffix of each distinct window is held.

Words are what stands between ASCII white space, with case and punctuation.
Groups may lie in one document or in many; touching and overlapping repeated
windows of a document are one span.

Defined cases: null texts, null doc_ids and texts of fewer than THRESHOLD words
have no window; very long texts are taken whole; rows of one doc_id with
different texts are different documents, each with its own spans; rows that
repeat doc_id and text repeat each other's windows, as any copy does, and are
reported once; ids may be of any type; an empty table gives no rows; columns
other than doc_id and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import textkit as tk
from tracemill.llm.cluster import prepare
from tracemill.llm.columns import identified, quoted

THRESHOLD = 50
GRAM = 8
#: Bytes of rows that are sorted together.
BATCH_BYTES = 4 << 20
#: end_word is set where a span is known to repeat and passes through; told: the suffixes were reported already; words: the run's words, each with a space behind it.
SCHEMA = "digit long, doc_id {}, text_key long, first_word int, suffixes int, end_word int, told boolean, words binary"
NAMES = ["digit", "doc_id", "text_key", "first_word", "suffixes", "end_word", "told", "words"]
FOUND = "doc_id {}, text_key long, first_word int, end_word int"


def passes(depth: int, first: int = 1) -> list[tuple[int, int]]:
    """(start, words) of the digits of a window, from the most significant: `first` words, then as many as there were before."""
    out, at = [], 0
    while at < depth:
        n = min(max(first, at), depth - at)
        out.append((at, n))
        at += n
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def spaced(words: tk.Words) -> tuple[bytes, np.ndarray]:
    """(all words, each with one space behind it; where each starts, and the end)."""
    size = words.end - words.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = words.data[np.minimum(np.arange(at[-1]) + np.repeat(words.start - at[:-1], size), max(0, len(words.data) - 1))]
    out[at[1:] - 1] = 32
    return out.tobytes(), at


def together(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys equal a neighbour in all of them."""
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    out = np.zeros(len(keys[0]), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def radix_groups(hashes: np.ndarray, at: np.ndarray, bucket: np.ndarray | None, digits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes that share all digits with another one of their bucket, in groups; the group of each).

    at: the suffixes' first words among the words of `hashes`.
    """
    up, down = tk.powers(len(hashes) + 1, 1)
    total = np.zeros(len(hashes) + 1, tk.U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    left, group = np.arange(len(at)), bucket
    for start, n in digits:
        a = at[left] + start
        digit = tk.mix((total[a + n] - total[a]) * down[a])
        order = np.argsort(digit, kind="stable") if group is None else np.lexsort([digit, group])
        keys = [digit[order]] if group is None else [group[order], digit[order]]
        stay = together(*keys)
        left, keys = left[order][stay], [k[stay] for k in keys]
        # Each group of this pass is a bucket of the next.
        new = np.zeros(len(left), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(new)
        if not len(left):
            break
    return left, group


def exact_groups(text: bytes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows equal another one of their group letter by letter, and which of those aren't the first of their kind."""
    again, later = np.zeros(len(group), bool), np.zeros(len(group), bool)
    bound = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
    low, high = start.tolist(), end.tolist()
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        one = text[low[a] : high[a]]
        if all(text[low[i] : high[i]] == one for i in range(a + 1, b)):
            again[a:b], later[a + 1 : b] = True, True
            continue
        # Different windows with equal hashes.
        first: dict[bytes, int] = {}
        for i in range(a, b):
            k = first.setdefault(text[low[i] : high[i]], i)
            if k != i:
                again[k] = again[i] = later[i] = True
    return again, later


def repeats(text: bytes, edge: np.ndarray, hashes: np.ndarray, at: np.ndarray, bucket: np.ndarray | None, depth: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes `at`: (which equal another one of their bucket in `depth` words, which of those aren't the first of their kind)."""
    again, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    left, group = radix_groups(hashes, at, bucket, passes(depth, first))
    if len(left):
        # Of a kind, the first suffix comes first.
        order = np.lexsort([left, group])
        left, group = left[order], group[order]
        again[left], later[left] = exact_groups(text, edge[at[left]], edge[at[left] + depth], group)
    return again, later


def _starts(*columns: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where a new run begins: a column changes, or step doesn't go up by one."""
    new = step[1:] != step[:-1] + 1
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(step) else np.zeros(0, np.int64)


def _digits(depth: int, gram: int):
    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in tk.chunks(batch.column(1)):
                w = tk.Words(data, off)
                n = len(w) - depth + 1
                at = np.flatnonzero(w.row[: max(0, n)] == w.row[depth - 1 :]) if n > 0 else np.zeros(0, np.int64)
                if not len(at):
                    continue
                every = np.arange(len(w) - gram + 1)
                first = sliding_min(tk.span_hash(w.hash, every, every + gram, 2), depth - gram + 1)[at]
                row, (text, edge) = w.row[at], spaced(w)
                ids, keys = (batch.column(c).slice(a, b - a) for c in (0, 2))
                again, later = repeats(text, edge, w.hash, at, None, depth, min(16, depth))
                # Known to repeat: spans that only pass through, spread over the tasks.
                known = np.flatnonzero(again)
                if len(known):
                    start = _starts(row[known], step=at[known])
                    end = np.concatenate([start[1:], [len(known)]]) - 1
                    r, m = row[known[start]], len(start)
                    of = pa.array(r)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(tk.mix(at[known[start]].astype(tk.U) + first[known[start]] * tk.GOLD).view(np.int64)), ids.take(of), keys.take(of), pa.array((at[known[start]] - w.first[r]).astype(np.int32)), pa.array(np.zeros(m, np.int32)),
                        pa.array((at[known[end]] - w.first[r] + depth).astype(np.int32)), pa.array(np.zeros(m, bool)), pa.nulls(m, pa.binary()),
                    ], NAMES)
                sent = np.flatnonzero(~later)
                first, row, at, again = first[sent], row[sent], at[sent], again[sent]
                start = _starts(first, row, again, step=at)
                end = np.concatenate([start[1:], [len(at)]]) - 1
                of = pa.array(row[start])
                words = [text[x:y] for x, y in zip(edge[at[start]].tolist(), edge[at[end] + depth].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(first[start].view(np.int64)), ids.take(of), keys.take(of), pa.array((at[start] - w.first[row[start]]).astype(np.int32)), pa.array((end - start + 1).astype(np.int32)),
                    pa.nulls(len(start), pa.int32()), pa.array(again[start]), pa.array(words, pa.binary()),
                ], NAMES)

    return digits


class _Sorter:
    """The passes over rows that come sorted by their digit, some batches at a time.

    Of the last bucket of a batch, which the next may go on with, one suffix of
    each distinct window is held with whether it was reported; memory follows the
    distinct windows of one bucket, not how often they occur.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self.held: pa.Table | None = None

    def take(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        known = pc.is_valid(rows.column(5))
        if pc.any(known).as_py():
            yield from rows.filter(known).select(["doc_id", "text_key", "first_word", "end_word"]).combine_chunks().to_batches()
            rows = rows.filter(pc.invert(known))
        if self.held is not None:
            rows = pa.concat_tables([self.held, rows])
        if not rows.num_rows:
            return
        digit = rows.column(0).to_numpy()
        last = digit[-1]
        # A row that is alone in its bucket repeats nothing beyond what its piece of input told; the last bucket may go on.
        live = rows.take(pa.array(np.flatnonzero(together(digit) | (digit == last)))).combine_chunks()
        digit = live.column(0).to_numpy()
        count = live.column(4).to_numpy().astype(np.int64)
        text = live.column(7)
        data, off = tk.buffers(text.chunk(0).cast(pa.large_binary()).view(pa.large_string()) if text.num_chunks else pa.array([], pa.large_string()))
        data, off = data[off[0] : off[-1]], off - off[0]
        w = tk.Words(data, off)
        row = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = w.first[row] + inside
        raw, edge = data.tobytes(), np.concatenate([w.start, [len(data)]])
        bucket = np.cumsum(np.concatenate([[0], digit[1:] != digit[:-1]]))[row]
        again, _ = repeats(raw, edge, w.hash, at, bucket, self.depth, 1)
        told = live.column(6).to_numpy()[row]
        first = live.column(3).to_numpy().astype(np.int64)[row] + inside
        self.held = self._hold(live, raw, edge, at, row, first, told | again, np.flatnonzero(digit[row] == last))
        tell = np.flatnonzero(again & ~told)
        if not len(tell):
            return
        new = _starts(row[tell], step=inside[tell])
        end = np.concatenate([new[1:], [len(tell)]]) - 1
        of = pa.array(row[tell[new]])
        yield pa.RecordBatch.from_arrays([
            *(live.column(c).combine_chunks().take(of) for c in (1, 2)), pa.array(first[tell[new]].astype(np.int32)), pa.array((first[tell[end]] + self.depth).astype(np.int32)),
        ], ["doc_id", "text_key", "first_word", "end_word"])

    def _hold(self, live: pa.Table, raw: bytes, edge: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, told: np.ndarray, mine: np.ndarray) -> pa.Table:
        kinds: dict[bytes, int] = {}
        for i, x, y in zip(mine.tolist(), edge[at[mine]].tolist(), edge[at[mine] + self.depth].tolist()):
            kinds.setdefault(raw[x:y], i)
        keep = np.fromiter(kinds.values(), np.int64, len(kinds))
        of, n = pa.array(row[keep]), len(keep)
        columns = [*(live.column(c).take(of) for c in (0, 1, 2)), pa.array(first[keep].astype(np.int32)), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int32()), pa.array(told[keep]), pa.array(list(kinds), pa.binary())]
        return pa.table(columns, schema=live.schema)


def _repeated(depth: int):
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, waiting, size = _Sorter(depth), [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
                if size >= BATCH_BYTES:
                    yield from sorter.take(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if waiting:
            yield from sorter.take(pa.Table.from_batches(waiting))

    return repeated


def repeated_spans(docs: DataFrame, depth: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """doc_id, first_word, end_word: the maximal spans of each document that repeated windows of `depth` words cover."""
    prepare(docs.sparkSession)
    doc_id, kind = identified(docs, "doc_id")
    text = quoted("text").cast("string")
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = texts.mapInArrow(_digits(depth, min(gram, depth)), SCHEMA.format(kind))
    found = rows.repartition("digit").sortWithinPartitions("digit").mapInArrow(_repeated(depth), FOUND.format(kind))
    order = Window.partitionBy("doc_id", "text_key").orderBy("first_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", (before.isNull() | (F.col("first_word") > before)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "text_key", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")).drop("span", "text_key")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(depth: int = THRESHOLD) -> str:
    """The spans of documents in DuckDB's SQL."""
    return rf"""
WITH words AS (SELECT doc_id, md5(text) AS version, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT doc_id, version, list_transform(range(1, len(w) - {depth - 2}), lambda a: md5(array_to_string(w[a:a + {depth - 1}], ' '))) AS h FROM words WHERE len(w) >= {depth}),
suffixes AS (SELECT doc_id, version, unnest(h) AS h, unnest(range(len(h))) AS a FROM windows),
repeated AS (SELECT DISTINCT doc_id, version, a FROM suffixes WHERE h IN (SELECT h FROM suffixes GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, version, a, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, version ORDER BY a) <= {depth} THEN 0 ELSE 1 END AS new FROM repeated),
spans AS (SELECT doc_id, version, a, sum(new) OVER (PARTITION BY doc_id, version ORDER BY a) AS span FROM marked)
SELECT doc_id, min(a)::INT AS first_word, (max(a) + {depth})::INT AS end_word FROM spans GROUP BY doc_id, version, span
"""
