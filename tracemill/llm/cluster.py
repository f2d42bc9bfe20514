"""What the operators need of the session: batch size and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Documents and bytes in an Arrow batch at most: long texts then don't fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and see that a shared checkpoint folder is set.

    Limits that are lower already stay.  The folder is the one of
    spark.checkpoint.dir.  Where that is unset, a temporary folder is used on
    one machine only; on a cluster that is an error, as other machines wouldn't
    see it.
    """
    for name, most in _LIMITS.items():
        have = spark.conf.get(name, None)
        if have is None or not 0 < _bytes(have) <= most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tracemill-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark


def _bytes(size: str) -> int:
    """The number of a setting, which may have a unit."""
    digits = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits.rstrip("kmg")) << unit


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    What is computed once is then neither computed again by each consumer nor
    lost with an executor.
    """
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
