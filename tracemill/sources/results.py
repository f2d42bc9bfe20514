"""Results out of the engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ndjson(df: DataFrame) -> DataFrame:
    """One JSON object a row, in a column `value`; nulls are written."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    ndjson(df).write.text(path)


def arrow(df: DataFrame) -> pa.Table:
    """The result as an Arrow table on the driver: for results that are known to be small."""
    return df.toArrow()
