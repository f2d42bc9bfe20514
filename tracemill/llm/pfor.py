"""Token ids as patched frame-of-reference blocks.

A document's ids are cut into blocks of BLOCK.  Each block subtracts its
minimum and packs the differences at the width that PERCENTILE of them need;
the differences beyond are exceptions: packed as zero, with their positions and
values in a list behind the packed bits.  The start of each block is indexed,
so that one block can be read alone.

Block layout (little endian): minimum uint32, width uint8, number of exceptions
uint16, number of values - 1 uint8; ceil(values * width / 8) bytes of packed
bits, lowest first; the exceptions' positions, uint8 each; their values, uint32
each.

All blocks of one width in a batch of documents are packed together, as arrays.

Defined cases: a null or empty text is a document of no blocks and an empty
blob; null doc_ids are kept, ids may be of any type; very long texts are written
whole; rows that
repeat are each written; an empty table gives no rows; further columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import tokens as tk
from tracemill.llm.cluster import prepare
from tracemill.llm.columns import identified, quoted

BLOCK = 128
PERCENTILE = 0.90
HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("last", "u1")])
SCHEMA = "doc_id {}, n_tokens int, block_starts array<int>, blob binary"


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0. Exact below 2**52."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) * (x > 0)


def encode(lists: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[list[bytes], list[np.ndarray]]:
    """(blob, block starts) of each list of ids below 2**32. block: 256 at most."""
    size = np.array([len(x) for x in lists], np.int64)
    blocks = -(-size // block)
    total = int(blocks.sum())
    if not total:
        return [b""] * len(lists), [np.zeros(0, np.int32)] * len(lists)
    owner = np.repeat(np.arange(len(lists)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n = np.minimum(block, size[owner] - nth * block)
    # A row for each block; short ones are filled with their own last value and cut when written.
    flat = np.concatenate(lists).astype(np.int64)
    start = np.repeat(np.cumsum(size) - size, blocks) + nth * block
    v = flat[np.minimum(start[:, None] + np.arange(block), (start + n - 1)[:, None])]
    low = v.min(1)
    v -= low[:, None]
    need = bit_length(v)
    real = np.arange(block) < n[:, None]
    ranked = np.sort(np.where(real, need, 64), 1)
    width = ranked[np.arange(total), np.ceil(n * percentile).astype(np.int64) - 1]
    over = (need > width[:, None]) & real
    patched = np.where(over | ~real, 0, v).astype(np.uint32)
    exceptions = over.sum(1)
    length = HEAD.itemsize + -(-n * width // 8) + 5 * exceptions
    end = np.cumsum(length)
    begin = end - length
    out = np.zeros(int(end[-1]), np.uint8)
    head = np.zeros(total, HEAD)
    head["minimum"], head["width"], head["exceptions"], head["last"] = low, width, exceptions, n - 1
    out[(begin[:, None] + np.arange(HEAD.itemsize)).ravel()] = head.view(np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(np.ascontiguousarray(patched[rows]).astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little", count=int(w)) if w <= 32 else None
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        take = -(-n[rows] * w // 8)
        full = take == packed.shape[1]
        at = begin[rows] + HEAD.itemsize
        out[(at[full][:, None] + np.arange(packed.shape[1])).ravel()] = packed[full].ravel()
        for i in np.flatnonzero(~full):
            out[at[i] : at[i] + take[i]] = packed[i, : take[i]]
    row, column = np.nonzero(over)
    k = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = begin[row] + HEAD.itemsize + -(-n * width // 8)[row]
    out[tail + k] = column
    value = np.ascontiguousarray(v[row, column]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[((tail + exceptions[row] + 4 * k)[:, None] + np.arange(4))] = value
    cut = np.concatenate([[0], np.cumsum(blocks)])
    edge = np.concatenate([begin, end[-1:]])
    blobs = [out[edge[a] : edge[b]].tobytes() if b > a else b"" for a, b in zip(cut[:-1], cut[1:])]
    return blobs, [(begin[a:b] - edge[a]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]


def decode_block(blob: bytes, start: int) -> np.ndarray:
    """The ids of the block that starts at `start`."""
    h = np.frombuffer(blob, HEAD, 1, start)[0]
    n, w, e = int(h["last"]) + 1, int(h["width"]), int(h["exceptions"])
    at = start + HEAD.itemsize
    used = -(-n * w // 8)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, used, at), bitorder="little")[: n * w].reshape(n, w)
    v = bits.astype(np.int64) @ (1 << np.arange(w, dtype=np.int64)) if w else np.zeros(n, np.int64)
    where = np.frombuffer(blob, np.uint8, e, at + used)
    v[where] = np.frombuffer(blob, "<u4", e, at + used + e)
    return v + int(h["minimum"])


def decode(blob: bytes, starts: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([decode_block(blob, int(s)) for s in starts]) if len(starts) else np.zeros(0, np.int64)


def _write(folder: str, vocabulary: str, block: int, percentile: float):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 100):
                batch = whole.slice(a, 100)
                ids = [tk.ids(t, folder, vocabulary) for t in batch.column(1).to_pylist()]
                blobs, starts = encode(ids, block, percentile)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([s.tolist() for s in starts], pa.list_(pa.int32())), pa.array(blobs, pa.binary()),
                ], ["doc_id", "n_tokens", "block_starts", "blob"])

    return write


def to_blocks(docs: DataFrame, folder: str = tk.VOCABULARIES, vocabulary: str = tk.VOCABULARY, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """doc_id, n_tokens, block_starts and blob: a row for each document, where it was read."""
    prepare(docs.sparkSession)
    doc_id, kind = identified(docs, "doc_id")
    return docs.select(doc_id, quoted("text").cast("string")).mapInArrow(_write(folder, vocabulary, block, percentile), SCHEMA.format(kind))


def op6_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
