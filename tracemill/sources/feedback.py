"""Questions asked, the queries they became, and whether people took them: a small append-only table, the latest row of an id wins."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, at_ns long, question string, query string, accepted boolean"


class Feedback:
    def __init__(self, spark: SparkSession, path: str, now=time.time_ns):
        self.spark, self.path, self.now = spark, path, now

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def add(self, question: str, query: str) -> str:
        key = uuid.uuid4().hex
        self._append(key, self.now(), question, query, None)
        return key

    def rate(self, key: str, accepted: bool) -> None:
        old = self.history().filter(F.col("id") == key).first()
        if old is None:
            raise KeyError(key)
        self._append(key, self.now(), old.question, old.query, accepted)

    def history(self) -> DataFrame:
        """The latest row of each id."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at_ns"), F.desc_nulls_last("accepted")))).filter("__n = 1").drop("__n")

    def examples(self, n: int = 10) -> list[tuple[str, str]]:
        """The last n accepted questions with their queries."""
        return [(r.question, r.query) for r in self.history().filter("accepted").orderBy(F.desc("at_ns"), "id").limit(n).collect()]
