"""A consistent-hash ring over a key column."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VIRTUAL = 150


class Ring:
    """Each node has `virtual` places on a ring of 64-bit hashes; a key belongs to the next place clockwise."""

    def __init__(self, nodes: list[str], virtual: int = VIRTUAL):
        if not nodes:
            raise ValueError("a ring needs a node")
        self.nodes = sorted(set(nodes))
        places = sorted((self.place(f"{n}#{i}"), n) for n in self.nodes for i in range(virtual))
        self.hashes = np.array([h for h, _ in places], np.uint64)
        self.owners = [n for _, n in places]

    @staticmethod
    def place(text: str) -> int:
        return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")

    def replicas(self, at: int, n: int) -> list[str]:
        """The first n distinct nodes clockwise from a place."""
        out: dict[str, None] = {}
        for k in range(len(self.owners)):
            out[self.owners[(at + k) % len(self.owners)]] = None
            if len(out) == min(n, len(self.nodes)):
                break
        return list(out)

    def locate(self, key: str, n: int = 1) -> list[str]:
        return self.replicas(int(np.searchsorted(self.hashes, np.uint64(self.place(key)))) % len(self.owners), n)


def series_key(name: Column | str, attributes: Column | str) -> Column:
    """What tells a series from others: its name and its labels, sorted, from the text of a JSON object."""
    pairs = F.transform(F.map_entries(F.from_json(attributes, "map<string, string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("\x1f", name, F.array_sort(pairs))


def assign(df: DataFrame, key: str, ring: Ring, replicas: int = 1, out: str = "nodes") -> DataFrame:
    """df with the nodes of each key, the first the owner; null keys have none."""
    lists = pa.array([ring.replicas(i, replicas) for i in range(len(ring.owners))], pa.list_(pa.string()))

    @F.arrow_udf(ArrayType(StringType()))
    def look(place: pa.Array) -> pa.Array:
        known = place.drop_null()
        wide = np.frombuffer(b"".join(known.to_pylist()), ">u8").astype(np.uint64) if len(known) else np.zeros(0, np.uint64)
        at = np.full(len(place), -1)
        at[place.is_valid().to_numpy(zero_copy_only=False)] = np.searchsorted(ring.hashes, wide) % len(lists)
        return lists.take(pa.array(at, mask=at < 0))

    # The first eight bytes of the digest.
    return df.withColumn(out, look(F.unhex(F.substring(F.md5(F.col("`" + key.replace("`", "``") + "`").cast("string")), 1, 16))))
