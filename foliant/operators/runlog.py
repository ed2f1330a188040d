"""A log of what operators read and gave, taken while they run.

Metrics are observed in the same pass as the result, so that nothing is computed twice to be counted.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "operator string, rows long, bytes long, started timestamp, elapsed_ms double"


class RunLog:
    """Records (RECORD) of the frames that are watched and of the results that are written.

    A watched frame is counted when a result that reads it is written; one that is read by several parts of a
    plan is counted once. Bytes are those of a named text or binary column, null where none is named."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.seen, self.watched = spark, [], []

    def watch(self, df: DataFrame, operator: str, bytes_of: str | None = None) -> DataFrame:
        found = Observation(f"{operator} {len(self.watched)}")
        size = F.sum(F.octet_length(F.col(bytes_of).cast("binary"))) if bytes_of else F.lit(None).cast("long")
        self.watched.append((operator, found))
        return df.observe(found, F.count(F.lit(1)).alias("rows"), F.max(size).alias("bytes") if not bytes_of else size.alias("bytes"))

    def write(self, df: DataFrame, operator: str, path: str, bytes_of: str | None = None) -> None:
        """Writes df as Parquet, and records it with all that it watches. A write that fails records nothing."""
        began, clock = time.time(), time.perf_counter()
        seen = self.watch(df, operator, bytes_of)
        seen.write.parquet(path)
        elapsed = 1000 * (time.perf_counter() - clock)
        for name, found in self.watched:
            told = found.get
            self.seen.append((name, told["rows"], told["bytes"], began, elapsed))
        self.watched = []

    def records(self) -> DataFrame:
        rows = [(name, n, size, began, elapsed) for name, n, size, began, elapsed in self.seen]
        return self.spark.createDataFrame(rows, "operator string, rows long, bytes long, began double, elapsed_ms double").select("operator", "rows", "bytes", F.timestamp_seconds("began").alias("started"), "elapsed_ms")
