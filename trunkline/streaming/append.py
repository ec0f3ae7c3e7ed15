"""Appending a stream to trunk files in order of time.

Time stamps never go back: a row older than the last one committed by earlier batches is not
written but set aside. Each batch is sorted; its files carry the batch number, and a batch that
runs again after a failure replaces its own files, rejects and mark, so nothing is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trunkline.sources import store
from trunkline.sources.trunklog import register


def last_committed(path: str, batch: int) -> int | None:
    """Greatest time stamp of the batches before ``batch``; the name of each mark holds it."""
    marks = [re.search(r"/(\d+)_(-?\d+)$", f) for f in store.listed(store.join(path, "_marks")) or []]
    return max((int(m[2]) for m in marks if m and int(m[1]) < batch), default=None)


def append_batch(rows: DataFrame, batch: int, path: str, rejected: str, codec: str = "gzip", trunk_kb: int = 512) -> None:
    """One batch (timestamp_millis, level_id, message, ...) to ``path``; late rows to Parquet below ``rejected``.

    A null time stamp has no place in the order and is set aside too.
    """
    spark, prefix = rows.sparkSession, f"batch-{batch:012d}-"
    register(spark)
    last = last_committed(path, batch)
    ts = F.col("timestamp_millis")
    fits = ts.isNotNull() if last is None else F.coalesce(ts >= last, F.lit(False))
    rows.where(~fits).write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={batch}")
    good = rows.where(fits)
    ordered = good.select("timestamp_millis", "level_id", "message").repartitionByRange("timestamp_millis").sortWithinPartitions("timestamp_millis")
    ordered.write.format("trunklog").mode("overwrite").option("prefix", prefix).option("compression", codec).option("trunkSizeKb", trunk_kb).save(path)
    top = good.agg(F.max("timestamp_millis")).first()[0]
    marks = store.join(path, "_marks")
    for old in store.listed(marks, prefix=f"{batch:012d}_") or []:
        store.remove(old)
    if top is not None:
        store.writer(store.join(marks, f"{batch:012d}_{top}")).close()


def append_stream(rows: DataFrame, path: str, rejected: str, checkpoint: str, codec: str = "gzip", trunk_kb: int = 512) -> DataStreamWriter:
    """A writer to start; ``checkpoint`` takes the place of the sidecar."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append_batch(df, n, path, rejected, codec, trunk_kb))
