"""Index maintenance: last write wins, in batch and from a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def append_stream(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start appending a stream of writes (doc_id, seq, ...) to a Parquet table that latest() reads; exactly once per batch.

    A checkpoint has a folder of its own, so a new checkpoint over an old table adds to it.
    """

    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
