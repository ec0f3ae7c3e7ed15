"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is contaminated by a test item when it holds at least 3/4 of the item's distinct
five-word shingles.

Jaccard similarity of a short item and a long document is near zero, so documents are
partitioned by size: class c holds those of 2**c to 2**(c+1) - 1 shingles, and its MinHash
sketch has 2**(c+2) bins (one permutation; the smallest hash of each bin). A bin then holds
half a document shingle at most on average, whatever the document's length, and a shared shingle
is the minimum of its bin on both sides with a probability above 3/4. An item of ``EXACT_BELOW``
shingles or more that is contained to 3/4 is missed with a probability under 0.3**18 = 4e-10;
shorter items are looked up with all of the document's shingles instead. Every candidate is
verified by exact shingle containment.

Items whose shingles are at most ``BROADCAST_SHINGLES`` in all are sent to every task (8 bytes
each for every size class); beyond that, sketches are joined by hash and the candidates' texts
brought together.

Shingles are compared as 64-bit hashes (words beyond 64 bytes by BLAKE2b).

Nulls: a null text is empty; empty documents and items match nothing. Rows without an id, repeated
rows and extra columns of any name are allowed: each document row gives its own result rows. Very long texts are
hashed in pieces; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import ByteHasher, documents, lean, quoted, shingle_sets, stored

SHINGLE_WORDS = 5
EXACT_BELOW = 24
BROADCAST_SHINGLES = 1_000_000
CLASSES = 32
FOUND = "doc_id long, item_id long, n_item_shingles long, n_shared long"
U = np.uint64


def size_class(n: int) -> int:
    return max(n, 1).bit_length() - 1


def sketch(ordered: np.ndarray, klass: int) -> np.ndarray:
    """Smallest hash of each of 2**(klass + 2) bins; ``ordered`` is sorted, a bin is a range of hashes."""
    bins = ordered >> U(62 - klass)
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    return ordered[first]


def item_sketch(ordered: np.ndarray, klass: int) -> np.ndarray:
    return ordered if len(ordered) < EXACT_BELOW else sketch(ordered, klass)


def shared(doc: np.ndarray, item: np.ndarray) -> int:
    at = np.searchsorted(doc, item)
    at[at == len(doc)] = 0
    return int((doc[at] == item).sum()) if len(doc) else 0


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])


def _broadcast_search(docs: DataFrame, items: list[tuple[int, str]], words: int) -> DataFrame:
    texts = [t or "" for _, t in items]
    ids = [i for i, _ in items]

    def run(batches):
        hasher = ByteHasher()
        sets = list(shingle_sets(pa.array(texts, pa.large_string()), hasher, words))
        tables: dict[int, tuple] = {}

        def table(klass: int):
            if klass not in tables:
                parts = [item_sketch(s, klass) for s in sets]
                hashes = np.concatenate([*parts, np.zeros(0, U)])
                owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                order = np.argsort(hashes, kind="stable")
                short = np.array([len(s) < EXACT_BELOW for s in sets], dtype=bool)
                exact = np.unique(np.concatenate([*[s for s in sets if len(s) < EXACT_BELOW], np.zeros(0, U)]))
                tables[klass] = hashes[order], owner[order], short, exact
            return tables[klass]

        for batch in batches:
            out = []
            for doc_id, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), hasher, words)):
                if not len(own):
                    continue
                klass = size_class(len(own))
                hashes, owner, _, exact = table(klass)
                if not len(hashes):
                    continue
                probe = np.union1d(sketch(own, klass), own[np.isin(own, exact, assume_unique=True)] if len(exact) else own[:0])
                lo, hi = np.searchsorted(hashes, probe, "left"), np.searchsorted(hashes, probe, "right")
                hit = hi > lo
                for item in sorted({int(owner[j]) for s, e in zip(lo[hit], hi[hit]) for j in range(s, e)}):
                    n = shared(own, sets[item])
                    if 4 * n >= 3 * len(sets[item]):
                        out.append((doc_id, ids[item], len(sets[item]), n))
            yield _record(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), FOUND)


def _keys(frame: DataFrame, words: int, item: bool, short: np.ndarray | None = None) -> DataFrame:
    """(id, klass, hash) of sketches, first column as id: a document's own class, an item's all classes; short items by class -1.

    ``short``: the only hashes that a document gives in class -1, if they are known; else it gives all of its own.
    """

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            for key, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), hasher, words)):
                if not len(own):
                    continue
                if item:
                    parts = [(-1, own)] if len(own) < EXACT_BELOW else [(c, sketch(own, c)) for c in range(CLASSES)]
                else:
                    all_ = own if short is None else own[np.isin(own, short, assume_unique=True)]
                    parts = [(-1, all_), (size_class(len(own)), sketch(own, size_class(len(own))))]
                for klass, hashes in parts:
                    for col, x in zip(cols, (np.full(len(hashes), key, np.int64), np.full(len(hashes), klass, np.int64), hashes.view(np.int64))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), pa.int64()) for c in cols], names=["id", "klass", "hash"])

    return frame.mapInArrow(lean(run), "id long, klass long, hash long")


def _joined_search(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    # rows, not ids, are joined: an id may be null or stand for several rows
    docs = stored(docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "contained-docs")
    items = stored(items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", F.col("text").alias("item_text")), "contained-items")
    right = stored(_keys(items.select("item_row", "item_text"), words, item=True).withColumnRenamed("id", "item_row"), "contained-keys")
    few = right.where("klass = -1").select("hash").distinct().limit(BROADCAST_SHINGLES + 1)
    got = few.collect() if few.count() <= BROADCAST_SHINGLES else None  # 8 bytes each; beyond, documents give all shingles, with the same result
    short = None if got is None else np.unique(np.array([r[0] for r in got], dtype=np.int64).view(U))
    left = _keys(docs.select("doc_row", "text"), words, item=False, short=short).withColumnRenamed("id", "doc_row")
    pairs = stored(left.join(right, ["klass", "hash"]).select("doc_row", "item_row").distinct(), "contained-pairs")
    both = pairs.join(items, "item_row").join(docs, "doc_row").select("doc_id", "text", "item_id", "item_text")

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            out = []
            for doc_id, item_id, own, item in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), hasher, words), shingle_sets(batch.column(3), hasher, words)):
                n = shared(own, item)
                if len(item) and 4 * n >= 3 * len(item):
                    out.append((doc_id, item_id, len(item), n))
            yield _record(out)

    return both.mapInArrow(lean(run), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE_WORDS, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every contaminated document."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    # a text of n bytes has at most n / 2 words and no more shingles
    bound = items.select(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if bound <= broadcast_shingles:
        found = _broadcast_search(docs, [tuple(r) for r in items.collect()], words)
    else:
        found = _joined_search(docs, items, words)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents: rows of a contaminated doc_id, and contaminated rows without doc_id."""
    benchmark = documents(spark, sf_dir, "benchmark")
    bad = stored(contaminated(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "contaminated")
    whole = docs.where("doc_id is not null").join(bad, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
    loose = stored(docs.where("doc_id is null").withColumn("__row", F.monotonically_increasing_id()), "without-id")
    found = contaminated(loose.select(F.col("__row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__row")).distinct()
    return whole.unionByName(loose.join(found, "__row", "left_anti").select(*[quoted(c) for c in docs.columns]))


def _shingles_sql(table: str, key: str) -> str:
    words = f"""SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}"""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM ({words})"""


ORACLE = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}), b AS ({_shingles_sql("benchmark", "item_id")}),
q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, q.n AS n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / q.n AS containment
FROM d JOIN b ON d.s = b.s JOIN q ON q.item_id = b.item_id
GROUP BY d.doc_id, b.item_id, q.n HAVING 4 * count(*) >= 3 * q.n
"""
