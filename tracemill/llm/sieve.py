"""A filter of fixed size ahead of a join: only rows that may match are moved.

The keys that are wanted are marked in a bitmap of BITS bits, PLACES bits a key.
Rows whose places are not all marked are certainly not wanted and stay where
they are; for the others the join decides.  The bitmap's size is a constant, so
what is broadcast doesn't grow with the data: with more keys more rows pass
without need, up to all of them, which is the join without this filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracemill.llm import textkit as tk

BITS, PLACES = 26, 3


def places(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit in it) of each of a key's places."""
    for k in range(1, PLACES + 1):
        at = tk.mix(keys.view(tk.U) + tk.U(k * int(tk.GOLD) % 2**64)) >> tk.U(64 - BITS)
        yield (at >> tk.U(6)).astype(np.int64), tk.U(1) << (at & tk.U(63))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmap = np.zeros(1 << BITS - 6, tk.U)
    for batch in batches:
        for word, bit in places(batch.column(0).to_numpy()):
            np.bitwise_or.at(bitmap, word, bit)
    word = np.flatnonzero(bitmap)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bitmap[word].view(np.int64))], ["word", "bits"])


def sieve(wanted: DataFrame) -> Callable[[Column], Column]:
    """From the one bigint column of keys, without nulls, a test of key columns: false only for keys that aren't there."""
    marked = wanted.mapInArrow(_mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << BITS - 6, tk.U)
    bitmap[marked.column(0).to_numpy()] = marked.column(1).to_numpy().view(tk.U)
    shared = wanted.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf(BooleanType())
    def maybe(key: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False).astype(np.int64)
        passed = np.ones(len(keys), bool)
        for word, bit in places(keys):
            passed &= shared.value[word] & bit != 0
        return pa.array(passed)

    return maybe
