"""Signals as Parquet: one layout for batches, streams and compaction.

    path/data/commit=<id>/part=<bucket start in ns>/*.parquet
    path/_commits/<time>-<id>.json

A write puts its files into a folder of its own and then publishes a commit, a
small file that names the partitions which it adds.  Readers take what the
published commits name, so they see a write whole or not at all, and what a
killed write left behind is never read.  A commit of an id that is published
already does nothing: a stream that repeats a batch after a failure writes it
once.  Compaction publishes one commit that adds the new files and withdraws the
old ones; the old files stay for readers that have begun, until `vacuum`.

Files are zstd, sorted by time, so that row groups' least and greatest times
prune, and carry a bloom filter on the column that is looked up by equality.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.engine import Engine
from tracemill.schema import SIGNALS, TIME

HOUR = 3600 * 10**9
BLOOM = {"logs": "severity_text", "metrics": "name", "traces": "trace_id"}
#: Files of a partition from which it is compacted, and bytes of a file then.
FILES, FILE_BYTES = 4, 512 << 20


def partitioned(df: DataFrame, signal: str, width: int = HOUR) -> DataFrame:
    t = F.col(TIME[signal])
    return df.withColumn("part", t - F.pmod(t, F.lit(width)))


def options(signal: str) -> dict[str, str]:
    return {"compression": "zstd", f"parquet.bloom.filter.enabled#{BLOOM[signal]}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _fs(spark: SparkSession, path: str):
    """(Hadoop's Path, the file system of path)."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path, Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Commit:
    id: str
    signal: str
    at_ns: int
    #: Partition: (files, bytes).
    adds: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: (commit, partition) that are no longer read.
    withdraws: frozenset[tuple[str, int]] = frozenset()


def _read_text(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Make a file that is either there whole or not at all."""
    Path, fs = _fs(spark, path)
    folder, _, name = path.rpartition("/")
    half = Path(f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(half, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(half, Path(path)):
        raise OSError(f"{path} couldn't be written")


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The published commits, in order."""
    Path, fs = _fs(spark, path)
    if fs.exists(Path(f"{path}/_spark_metadata")):
        raise ValueError(f"{path} was written by a file sink of Spark's; ingest it into a new store")
    folder, out = Path(f"{path}/_commits"), []
    for f in fs.listStatus(folder) if fs.exists(folder) else []:
        if not f.getPath().getName().startswith("_"):
            x = json.loads(_read_text(spark, fs, f.getPath()))
            out.append(Commit(x["id"], x["signal"], x["at_ns"], {int(k): tuple(v) for k, v in x["adds"].items()}, frozenset((c, p) for c, p in x["withdraws"])))
    return sorted(out, key=lambda c: (c.at_ns, c.id))


def live(found: list[Commit]) -> dict[tuple[str, int], tuple[int, int]]:
    """(commit, partition) to (files, bytes) of what is read."""
    gone = {x for c in found for x in c.withdraws}
    return {(c.id, p): n for c in found for p, n in c.adds.items() if (c.id, p) not in gone}


def _folder(path: str, commit: str) -> str:
    return f"{path}/data/commit={commit}"


def stage(df: DataFrame, signal: str, path: str, commit: str) -> None:
    """Write df, which has `part` and is shaped, where the commit's files belong; nobody reads it yet."""
    df.write.mode("overwrite").options(**options(signal)).partitionBy("part").parquet(_folder(path, commit))


def publish(spark: SparkSession, signal: str, path: str, commit: str, withdraws: list[tuple[str, int]] = ()) -> None:
    """Let readers see the commit's files instead of those withdrawn."""
    Path, fs = _fs(spark, path)
    adds: dict[int, list[int]] = {}
    folder = Path(_folder(path, commit))
    files = fs.listFiles(folder, True) if fs.exists(folder) else None
    while files is not None and files.hasNext():
        f = files.next()
        name, parent = f.getPath().getName(), f.getPath().getParent().getName()
        if name.endswith(".parquet") and parent.startswith("part="):
            n = adds.setdefault(int(parent[5:]), [0, 0])
            n[0] += 1
            n[1] += f.getLen()
    at = time.time_ns()
    fs.mkdirs(Path(f"{path}/_commits"))
    _write_text(spark, f"{path}/_commits/{at:020d}-{commit}.json", json.dumps({"id": commit, "signal": signal, "at_ns": at, "adds": adds, "withdraws": sorted(withdraws)}))


def published(spark: SparkSession, path: str, commit: str) -> bool:
    Path, fs = _fs(spark, path)
    folder = Path(f"{path}/_commits")
    return fs.exists(folder) and any(f.getPath().getName()[20:] == f"-{commit}.json" for f in fs.listStatus(folder))


def write(df: DataFrame, signal: str, path: str, width: int = HOUR, commit: str | None = None) -> str:
    """Append df as one commit, whose id is returned; late rows go to their own partitions.

    commit: an id of one's own, which makes a repeated write harmless.  Adaptive
    execution splits large partitions and joins small ones.
    """
    commit = commit or uuid.uuid4().hex
    if not published(df.sparkSession, path, commit):
        shaped = partitioned(df, signal, width).hint("rebalance", "part").sortWithinPartitions("part", TIME[signal])
        stage(shaped, signal, path, commit)
        publish(df.sparkSession, signal, path, commit)
    return commit


def _load(spark: SparkSession, path: str, signal: str, which: list[tuple[str, int]]) -> DataFrame:
    schema = T.StructType([*SIGNALS[signal].fields, T.StructField("commit", T.StringType()), T.StructField("part", T.LongType())])
    if not which:
        return spark.createDataFrame([], schema).drop("commit")
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{_folder(path, c)}/part={p}" for c, p in sorted(which)]).drop("commit")


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, width: int = HOUR) -> DataFrame:
    """What is stored, of the partitions that times low to high (inclusive) can be in; other folders aren't even listed."""
    found = commits(spark, path)
    if not found:
        raise FileNotFoundError(f"no store at {path}")
    least, most = (None if x is None else x - x % width for x in (low, high))
    return _load(spark, path, found[0].signal, [(c, p) for c, p in live(found) if (least is None or p >= least) and (most is None or p <= most)])


def register(engine: Engine, signal: str, path: str, width: int = HOUR) -> Engine:
    """The stored signal as a table whose time bounds prune partitions."""
    return engine.register(signal, read(engine.spark, path), partition=("part", width))


def parts(spark: SparkSession, path: str) -> dict[int, int]:
    """Partition to its number of data files."""
    out: dict[int, int] = {}
    for (_, p), (files, _) in live(commits(spark, path)).items():
        out[p] = out.get(p, 0) + files
    return out


def _slot(signal: str, files: dict[int, int], width: int) -> Column:
    """Which of its partition's new files a row belongs to: even ranges of time."""
    many = [x for p, n in files.items() if n > 1 for x in (F.lit(p), F.lit(n))]
    if not many:
        return F.lit(0)
    n = F.coalesce(F.try_element_at(F.create_map(*many), F.col("part")), F.lit(1))
    return F.floor((F.col(TIME[signal]) - F.col("part")) / F.lit(width) * n).cast("int")


def compact(spark: SparkSession, signal: str, path: str, least: int = FILES, file_bytes: int = FILE_BYTES, width: int = HOUR) -> list[int]:
    """Rewrite the partitions of `least` files (2 at least) as files of about file_bytes, sorted; the partitions that were.

    One job for all of them, and one commit: readers see the old files or the
    new.  Writes and streams may go on meanwhile; a second compaction may not.
    """
    Path, fs = _fs(spark, path)
    lock = Path(f"{path}/_compacting")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{path} is being compacted; remove {lock.toString()} if that was killed")
    try:
        size: dict[int, list[int]] = {}
        now = live(commits(spark, path))
        for (_, p), (files, b) in now.items():
            n = size.setdefault(p, [0, 0])
            n[0] += files
            n[1] += b
        files = {p: max(1, -(-b // file_bytes)) for p, (n, b) in size.items() if n >= max(2, least)}
        if not files:
            return []
        old = [(c, p) for c, p in now if p in files]
        rows = _load(spark, path, signal, old).withColumn("__slot", _slot(signal, files, width))
        commit = uuid.uuid4().hex
        stage(rows.repartitionByRange(sum(files.values()), "part", "__slot").drop("__slot").sortWithinPartitions("part", TIME[signal]), signal, path, commit)
        publish(spark, signal, path, commit, old)
        return sorted(files)
    finally:
        fs.delete(lock, False)


def move(spark: SparkSession, path: str, to: str, before: int) -> list[int]:
    """Move the partitions that begin before a time to another store, of any file system; those partitions.

    They are published there first and withdrawn here then: between the two they
    are in both, and never in neither.  Done again after a failure, it moves
    what is still here; the commit there is named by what it holds, so nothing
    is in it twice.
    """
    found = commits(spark, path)
    old = sorted((c, p) for c, p in live(found) if p < before)
    if not old:
        return []
    signal, commit = found[0].signal, hashlib.md5(json.dumps([path, old]).encode()).hexdigest()
    if not published(spark, to, commit):
        rows = _load(spark, path, signal, old).hint("rebalance", "part").sortWithinPartitions("part", TIME[signal])
        stage(rows, signal, to, commit)
        publish(spark, signal, to, commit)
    publish(spark, signal, path, f"moved-{commit}", old)
    return sorted({p for _, p in old})


def vacuum(spark: SparkSession, path: str, older_than_s: float = 3600.0) -> int:
    """Delete what no reader has used for that long: withdrawn files, and those of writes that were never published. The number of folders."""
    Path, fs = _fs(spark, path)
    found = commits(spark, path)
    before, n, kept, known = time.time_ns() - int(older_than_s * 1e9), 0, live(found), {c.id for c in found}
    for c in found:
        if c.at_ns <= before:
            for other, p in c.withdraws:
                n += fs.delete(Path(f"{_folder(path, other)}/part={p}"), True)
    data = Path(f"{path}/data")
    for d in fs.listStatus(data) if fs.exists(data) else []:
        commit = d.getPath().getName().removeprefix("commit=")
        if commit not in known and d.getModificationTime() * 10**6 <= before:
            n += fs.delete(d.getPath(), True)
        elif commit in known and not any(c == commit for c, _ in kept) and not fs.listStatus(d.getPath()):
            fs.delete(d.getPath(), True)
    return n
