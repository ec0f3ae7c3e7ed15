"""Rotation of log files by size, and the shift of their archives."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fill:
    """Sequential fill of one file: how many times it has rotated, and the bytes that it holds.

    A text file rotates before a write that would pass ``limit``; with ``after``, a trunk file
    rotates once a write has passed it. A limit of 0 or less never rotates. A new file holds ``begin`` bytes.
    """

    def __init__(self, limit: int, after: bool = False, begin: int = 0) -> None:
        self.limit, self.after, self.turn, self.begin, self.held = limit, after, 0, begin, begin

    def take(self, size: int) -> int:
        """Rotations before the write of ``size`` bytes."""
        if not self.after and self.held > self.begin and 0 < self.limit < self.held + size:
            self.turn, self.held = self.turn + 1, self.begin
        mine = self.turn
        self.held += size
        if self.after and 0 < self.limit < self.held:
            self.turn, self.held = self.turn + 1, self.begin
        return mine


def rotated(rows: DataFrame, target: str, size: str, order: str, limit: int, after: bool = False, begin: int = 0) -> DataFrame:
    """``rows`` (target, order, size) with ``segment``: the rotation count of the target's file at each row.

    The fill is sequential, so a target is one task; it streams over sorted batches and holds two
    numbers. Null targets are one target, null sizes are 0 bytes.
    """
    slim = rows.select(F.coalesce(F.col(target).cast("string"), F.lit("")).alias(target), F.col(order).cast("long").alias(order), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))

    def run(batches):
        name, fill = None, None
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (mine, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if mine != name:
                    name, fill = mine, Fill(limit, after, begin)
                out[i] = fill.take(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[target, order, size, "segment"])

    return slim.repartition(target).sortWithinPartitions(target, order).mapInArrow(run, f"`{target}` string, `{order}` long, `{size}` long, segment long")


def retained(segmented: DataFrame, target: str, most: int) -> DataFrame:
    """Rows still on disk with ``archive``: null in the active file, 1 in the newest archive, up to ``most``."""
    last = segmented.groupBy(target).agg(F.max("segment").alias("_last"))
    age = F.col("_last") - F.col("segment")
    return segmented.join(last, target).where(age <= max(most, 0)).withColumn("archive", F.when(age > 0, age)).drop("_last")


def archive_moves(existing: Iterable[int], most: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(archives to delete, moves in the order to make them) of one rotation; 0 names the active file.

    Without archives allowed, the active file itself is deleted.
    """
    if most <= 0:
        return [0], []
    have = set(existing)
    return [most] if most in have else [], [(i, i + 1) for i in range(most - 1, 0, -1) if i in have] + [(0, 1)]
