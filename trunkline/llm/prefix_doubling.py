"""Prefix doubling over every position, in Spark sorts: the dealt method of operator 7, for corpora that can pay for it.

``suffix_dedup`` gives the same result through sampled positions; the README has the figures of both.

A position's rank for the first bytes is their number; ranks for h bytes and for h bytes further on make
a pair, distinct pairs are sorted, and their places are the ranks for 2 * h bytes. A class of one
document only can't become a repeat, nor can it be the second half of one, so its positions drop out
of all later rounds. The last round's halves overlap, so that it ends at exactly ``length`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trunkline.llm.common import lean, stored, text_chunks

FIRST = 7


def positions(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(row, doc_id, at, rank) of every position with ``first`` bytes ahead, 7 at most, which are the rank; rows may share a doc_id."""

    def run(batches):
        for batch in batches:
            rows, ids = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            for lo, hi, data, at in text_chunks(batch.column(2)):
                for i in range(hi - lo):
                    own = data[at[i] : at[i + 1]].astype(np.int64)
                    n = len(own) - first + 1
                    if n > 0:
                        rank = sum(own[k : k + n] << (8 * (first - 1 - k)) for k in range(first))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows[lo + i])), pa.array(np.full(n, ids[lo + i])), pa.array(np.arange(n)), pa.array(rank)], names=["row", "doc_id", "at", "rank"])

    texts = docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(lean(run), "row long, doc_id long, at long, rank long")


def repeated_windows(docs: DataFrame, length: int, first: int = FIRST) -> DataFrame:
    """(doc_id, at): where ``length`` bytes begin that also begin in a document with a smaller doc_id."""
    have = min(first, length)
    rows, least = stored(positions(docs, have), "doubling-0"), None
    while have < length:
        step = min(have, length - have)
        ahead = rows.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = stored(rows.select("row", "doc_id", "at", "rank").join(ahead, ["row", "at"]), f"doubling-pairs-{have}")
        shared = pairs.groupBy("rank", "next").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        ranked = stored(shared.orderBy("rank", "next").select("rank", "next", "least", F.monotonically_increasing_id().alias("place")), f"doubling-ranks-{have}")
        have += step
        joined = pairs.join(ranked, ["rank", "next"]).select("row", "doc_id", "at", F.col("place").alias("rank"), "least")
        rows = stored(joined, f"doubling-{have}")
        least = rows
    if least is None:
        one = rows.groupBy("rank").agg(F.min("doc_id").alias("least"))
        least = rows.join(one, "rank")
    return least.where("doc_id > least").select("doc_id", "at").distinct()
