"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as
many of 2 ** LARGEST as fit, then one for each binary digit of the rest, from
the highest.  Pieces of equal length form a bucket, and batches take pieces of
one bucket only: there is no padding, no token is lost, and no sequence crosses
a document.  A batch holds BATCH_TOKENS tokens.

Every task packs what it reads.  A batch is named by its bucket, its task and a
number; the last batch of a bucket in a task may be smaller.  So nothing is
shuffled, and the documents' tokens are written where they are made.

Defined cases: a null or empty text has no pieces; null doc_ids keep
theirs, ids may be of any type; a
very long text is tokenised whole; rows that repeat are each packed; an empty
table gives no rows; columns other than doc_id and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import tokens as tk
from tracemill.llm.cluster import prepare
from tracemill.llm.columns import identified, quoted

LARGEST = 11
BATCH_TOKENS = 1 << 15
SCHEMA = "doc_id {}, piece int, first_token int, bucket int, n_tokens int, batch long, tokens array<int>"


def decompose(n: int, largest: int = LARGEST) -> list[int]:
    """The exponents of the pieces of n tokens, in order."""
    return [largest] * (n >> largest) + [b for b in range(largest - 1, -1, -1) if n >> b & 1]


def _pack(folder: str, vocabulary: str, largest: int, batch_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        made = np.zeros(largest + 1, np.int64)
        room = np.array([max(1, batch_tokens >> b) for b in range(largest + 1)])
        for batch in batches:
            doc, ids = batch.column(0), [tk.ids(t, folder, vocabulary) for t in batch.column(1).to_pylist()]
            cut = [decompose(len(x), largest) for x in ids]
            count = np.array([len(c) for c in cut], np.int64)
            if not count.sum():
                continue
            bucket = np.concatenate([np.array(c, np.int64) for c in cut])
            row = np.repeat(np.arange(len(cut)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = 1 << bucket
            end = np.cumsum(size)
            length = np.array([len(x) for x in ids], np.int64)
            first = end - size - np.repeat(np.cumsum(length) - length, count)
            number = np.zeros(len(row), np.int64)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                number[mine] = (made[b] + np.arange(len(mine))) // room[b]
                made[b] += len(mine)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                doc.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first, pa.int32()), pa.array(bucket, pa.int32()), pa.array(size, pa.int32()),
                pa.array(bucket << 56 | task << 28 | number),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(flat)),
            ], ["doc_id", "piece", "first_token", "bucket", "n_tokens", "batch", "tokens"])

    return pack


def pack(docs: DataFrame, folder: str = tk.VOCABULARIES, vocabulary: str = tk.VOCABULARY, largest: int = LARGEST, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, its place in the document, its bucket (log2 of its length), its batch and its token ids."""
    prepare(docs.sparkSession)
    doc_id, kind = identified(docs, "doc_id")
    return docs.select(doc_id, quoted("text").cast("string")).mapInArrow(_pack(folder, vocabulary, largest, batch_tokens), SCHEMA.format(kind))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
