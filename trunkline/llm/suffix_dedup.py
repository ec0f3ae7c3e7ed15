"""Removal of repeated byte strings by grouping fingerprints at sampled positions, in place of prefix doubling.

A byte goes when a 50-byte string over it also starts in a document with a smaller doc_id.

Ranking every position by sorting (rank, rank at offset) pairs takes one sort of all
positions for each doubling: 864 million rows of 16 bytes for 0.5 GB of Parquet, 14 GB a
sort (an estimate, not measured), against 2 GB that may be on disk. So strings of three
lengths are grouped by fingerprint, with no reranking, over a synchronizing set of positions, as sparse suffix arrays do: of each 50-byte window the leftmost position
with the smallest hash of its 20 bytes. Equal windows choose equal positions, so nothing
is lost, and one position in 16 takes part. Ranks are classes of equal strings, named by
64-bit fingerprints instead of by their place in the sorted order.

1. length 20: (rank of the 20 bytes at the position). Unique ranks drop out here.
2. the next length: all windows that chose the position, 50 to 80 bytes, ranked together
   with rank 1. An occurrence in a later document than the first of its class is settled:
   all its windows are repeats.
3. length 50, past the threshold: where one rank of step 1 split into several classes of
   step 2, the first occurrence of each class has its windows ranked one by one.

Only packed arrays are shuffled: fingerprints and doc_ids by fingerprint range, after each
task has kept the smallest doc_id of every class that it saw; the answers go back by doc_id.

Nulls: a null text is empty. A row without doc_id comes back unchanged with nothing removed
and takes no part. Rows that repeat a doc_id are one document to each other: no matches
between them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trunkline.llm.common import ByteHasher, carried, documents, give_back, lean, mix64, packed_texts, quoted, small_batches, stored, text_bytes, text_chunks, unpacked

LENGTH = 50
SEED = 20
#: Text bytes of a task whose classes are merged before they are shuffled.
FLUSH_BYTES = 6 << 20
#: Text bytes scanned at once; the arrays over them take about 100 bytes a byte.
SCAN_BYTES = 1 << 18
#: Text bytes for each partition of fingerprints, and fingerprint ranges for each partition (they are answered one by one).
PARTITION_BYTES = 16 << 20
PARTS_PER_PARTITION = 4
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
ANSWER = "doc_id long, settled binary, open binary"
U = np.uint64


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Sample:
    """Chosen positions of a buffer of whole documents, with the run of windows that chose each.

    row: document; lo, hi: first and last window start; seed, wide: ranks of steps 1 and 2.
    A single document beyond ``SCAN_BYTES`` is read in pieces cut between two runs, so that its runs
    are those of the whole.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, hasher: ByteHasher, length: int, seed: int) -> None:
        self.length, self.data, self.hasher = length, data, hasher
        empty = np.zeros(0, np.int64)
        self.row = self.lo = self.hi = empty
        self.seed = self.wide = np.zeros(0, U)
        if len(data) < length:
            return
        if len(at) == 2 and len(data) > SCAN_BYTES + length:
            self._read_pieces(seed)
        else:
            self._read(at, seed)

    def _read_pieces(self, seed: int) -> None:
        got, begin, count = [], 0, len(self.data) - self.length + 1
        while begin < count:
            end = min(begin + SCAN_BYTES, count)
            own = self.data[begin : end + self.length - 1]
            part = Sample(own, np.array([0, len(own)]), self.hasher, self.length, seed)
            whole = len(part.lo) - (end < count)  # the last run may go on
            got.append((part.lo[:whole] + begin, part.hi[:whole] + begin, part.seed[:whole], part.wide[:whole]))
            begin = count if end == count else begin + int(part.lo[-1])
        self.lo, self.hi, self.seed, self.wide = (np.concatenate([g[j] for g in got]) for j in range(4))
        self.row = np.zeros(len(self.lo), np.int64)

    def _read(self, at: np.ndarray, seed: int) -> None:
        hasher, length, n = self.hasher, self.length, len(self.data)
        prefix = hasher.prefix(self.data)
        start = np.arange(n - seed + 1)
        seeds = hasher.spans(prefix, start, start + seed)
        bits = U(max(20, n.bit_length()))
        low = window_minimum(((seeds >> bits) << bits) | start.astype(U), length - seed + 1)
        chosen = (low & ((U(1) << bits) - U(1))).astype(np.int64)
        spoiled = np.zeros(len(chosen) + 1, dtype=np.int64)
        for cut in at[1:-1]:
            spoiled[max(0, min(cut - length + 1, len(chosen)))] += 1
            spoiled[max(0, min(cut, len(chosen)))] -= 1
        valid = np.cumsum(spoiled[:-1]) == 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | first[1:]
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        place = chosen[self.lo]
        self.row = np.searchsorted(at, self.lo, side="right") - 1
        self.seed = seeds[place]
        whole = hasher.spans(prefix, self.lo, self.hi + length)
        self.wide = mix64(whole + (place - self.lo).astype(U) * U(0xC2B2AE3D27D4EB4F)) ^ self.seed

    def windows(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ranks of all windows of the picked positions, ascending."""
        many = self.hi[picked] - self.lo[picked] + 1
        start = np.repeat(self.lo[picked], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ranks, i = np.empty(len(start), U), 0
        while i < len(start):
            j = int(np.searchsorted(start, start[i] + SCAN_BYTES))
            own = start[i:j] - start[i]
            ranks[i:j] = self.hasher.spans(self.hasher.prefix(self.data[start[i] : start[j - 1] + self.length]), own, own + self.length)
            i = j
        return start, ranks


def merged(start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as maximal runs within each document; ``at``: where documents begin."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    row = np.searchsorted(at, start, side="right")
    first = np.flatnonzero(np.concatenate([[True], (start[1:] > reach[:-1]) | (row[1:] != row[:-1])]))
    return start[first], reach[np.concatenate([first[1:] - 1, [len(start) - 1]])]


def _packed(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Rows sorted by document: each document once, and for each column its values as bytes."""
    ids, cut = np.unique(doc, return_index=True)
    ends = [*cut[1:], len(doc)]
    return ids, [[c[s:e].tobytes() for s, e in zip(cut, ends)] for c in columns]


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Fingerprint range of each key, by the 48 bits that are shuffled; mixed first, as chosen positions have small hashes."""
    return (mix64(key >> U(16)) >> U(32)) * U(parts) >> U(32)


def _own_minimum(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its key, smallest doc of its key) after sorting by (key, doc)."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    return order, first, least


def _scan(docs: DataFrame, parts: int, length: int, seed: int) -> DataFrame:
    """Step 1 and 2 classes of each task, packed by fingerprint range (part); settled answers ride along (part -1-x)."""

    def run(batches):
        hasher = ByteHasher()
        held, size = [], 0

        def flush():
            doc = np.concatenate([h[0] for h in held])
            key = np.concatenate([h[1] for h in held])
            wide = np.concatenate([h[2] for h in held])
            order, first, least = _own_minimum(wide, doc)
            doc, key, wide = doc[order], key[order], wide[order]
            late = doc > least
            rest = first
            out = []
            part = _part(key[rest], parts)
            by = np.lexsort((doc[rest], part))
            p, d, k, w = part[by], doc[rest][by], key[rest][by], wide[rest][by]
            cut = np.searchsorted(p, np.arange(parts + 1, dtype=U))
            for i in range(parts):
                s, e = cut[i], cut[i + 1]
                if e > s:
                    ids, begin = np.unique(d[s:e], return_index=True)
                    many = np.diff([*begin, e - s])
                    many = many.astype(np.uint16 if many.max() < 1 << 16 else np.int64)
                    tail = w[s:e].astype(np.uint32).tobytes() + (w[s:e] >> U(32)).astype(np.uint8).tobytes()
                    out.append((i, ids.tobytes(), many.tobytes(), (k[s:e] >> U(32)).astype(np.uint32).tobytes() + ((k[s:e] >> U(16)) & U(0xFFFF)).astype(np.uint16).tobytes(), tail))
            if late.any():
                by = np.lexsort((wide[late], doc[late]))
                ids, (settled,) = _packed(doc[late][by], wide[late][by])
                for x, y in zip(ids, settled):
                    out.append((-1 - int(x) % parts, np.int64(x).tobytes(), b"", y, b""))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32())] + [pa.array([o[j] for o in out], pa.binary()) for j in range(1, 5)], names=["part", "docs", "many", "seeds", "wides"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in text_chunks(batch.column(1), SCAN_BYTES):
                s = Sample(data, at, hasher, length, seed)
                if len(s.lo):
                    doc = ids[lo:hi][s.row].astype(np.int64)
                    _, once = np.unique(doc.astype(U) * U(0x9E3779B97F4A7C15) ^ s.wide, return_index=True)
                    held.append((doc[once], s.seed[once], s.wide[once]))
                size += len(data)
                if size >= FLUSH_BYTES and held:
                    yield flush()
                    held, size = [], 0
                    give_back()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "part int, docs binary, many binary, seeds binary, wides binary")


def _answers(scanned: DataFrame, parts: int) -> DataFrame:
    """Per document the step 2 classes that are settled, and those that are first but open (step 3)."""

    def run(batches):
        got: dict[int, list] = {}

        def answer(rows: list):
            doc, key, tag = [], [], []
            for docs, many, seeds, wides in rows:
                d = np.frombuffer(docs, np.int64)
                n = len(seeds) // 6
                k = np.frombuffer(seeds, np.uint32, n).astype(U) << U(16) | np.frombuffer(seeds, np.uint16, n, 4 * n)
                m = np.frombuffer(many, np.uint16 if len(many) == 2 * len(d) else np.int64)
                doc.append(np.repeat(d, m))
                key.append(k)
                low = np.frombuffer(wides[: 4 * len(k)], np.uint32).astype(U)
                tag.append(low | (np.frombuffer(wides[4 * len(k) :], np.uint8).astype(U) << U(32)))
            doc, key, tag = np.concatenate(doc), np.concatenate(key), np.concatenate(tag)
            order = np.lexsort((doc, tag, key))
            doc, key, tag = doc[order], key[order], tag[order]
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new_tag = new_key.copy()
            new_tag[1:] |= tag[1:] != tag[:-1]
            of_key = np.cumsum(new_key) - 1
            heads = np.flatnonzero(new_key)
            several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
            tags = np.add.reduceat(new_tag.astype(np.int64), heads)
            least = doc[np.flatnonzero(new_tag)][np.cumsum(new_tag) - 1]
            settled = doc > least
            opened = (several & (tags > 1))[of_key] & ~settled
            return doc, key, tag, settled, opened

        def emit(rows: list):
            doc, key, tag, settled, opened = answer(rows)
            keep = settled | opened
            doc, key, tag, settled = doc[keep], key[keep], tag[keep], settled[keep]
            by = np.argsort(doc, kind="stable")
            doc, key, tag, settled = doc[by], key[by], tag[by], settled[by]
            ids, cut = np.unique(doc, return_index=True)
            ends = [*cut[1:], len(doc)]
            both = key ^ mix64(tag)  # names a class of step 2 for the way back
            pair = lambda s, e, m: both[s:e][m].tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([pair(s, e, settled[s:e]) for s, e in zip(cut, ends)], pa.binary()), pa.array([pair(s, e, ~settled[s:e]) for s, e in zip(cut, ends)], pa.binary())],
                names=["doc_id", "settled", "open"],
            )

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            ride = []
            for part, docs, many, seeds, wides in rows:
                if part < 0:
                    ride.append((int(np.frombuffer(docs, np.int64)[0]), b"W" + seeds))
                else:
                    got.setdefault(part, []).append((docs, many, seeds, wides))
            if ride:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ride], pa.int64()), pa.array([r[1] for r in ride], pa.binary()), pa.array([b""] * len(ride), pa.binary())], names=["doc_id", "settled", "open"])
        for part in list(got):
            yield emit(got.pop(part))
            give_back()

    return scanned.repartition(parts, "part").mapInArrow(lean(run), ANSWER)


def _marked(sample: Sample, row: int, settled: list[bytes] | None, opened: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the sample's positions in ``row`` that are settled, and that are open."""
    mine = np.arange(*np.searchsorted(sample.row, [row, row + 1]))
    wide, key = sample.wide[mine], sample.seed[mine] >> U(16)
    tag = (wide & U(0xFFFFFFFF)) | ((wide >> U(32)).astype(np.uint8).astype(U) << U(32))

    def among(blobs):
        whole = [np.frombuffer(b, np.uint8, offset=1).view(U) for b in blobs if len(b) % 8 == 1]
        pairs = [np.frombuffer(b, U) for b in blobs if len(b) % 8 == 0 and b]
        hit = np.isin(wide, np.concatenate(whole)) if whole else np.zeros(len(mine), bool)
        if pairs:
            hit |= np.isin(key ^ mix64(tag), np.concatenate(pairs))
        return hit

    done = among(settled or [])
    return mine[done], mine[among(opened or []) & ~done]


def _window_parts(placed: DataFrame, parts: int, length: int, seed: int) -> DataFrame:
    """Step 3: ranks of the windows of open positions, packed by fingerprint range; doc_ids as runs."""

    def run(batches):
        hasher = ByteHasher()
        held = []

        def flush():
            doc, rank = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            part = (rank >> U(32)) * U(parts) >> U(32)
            by = np.lexsort((doc, part))
            doc, rank = doc[by], rank[by]
            cut = np.searchsorted(part[by], np.arange(parts + 1, dtype=U))
            rows = []
            for i, (s, e) in enumerate(zip(cut, cut[1:])):
                if e > s:
                    ids, begin = np.unique(doc[s:e], return_index=True)
                    rows.append((i, ids.tobytes(), np.diff([*begin, e - s]).astype(np.int32).tobytes(), rank[s:e].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)], names=["part", "docs", "many", "ranks"])

        count = 0
        for batch in batches:
            ids, settled, opened = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for base, _, texts in unpacked(batch.column(1)):
                for lo, hi, data, at in text_chunks(texts, SCAN_BYTES):
                    s = Sample(data, at, hasher, length, seed)
                    for i in range(lo, hi):
                        _, todo = _marked(s, i - lo, settled[base + i].as_py(), opened[base + i].as_py())
                        if len(todo):
                            rank = np.unique(s.windows(todo)[1])
                            held.append((np.full(len(rank), ids[base + i], np.int64), rank))
                            count += len(rank)
                if count > 400_000:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return placed.select("doc_id", "packed", "settled", "open").mapInArrow(lean(run), "part int, docs binary, many binary, ranks binary")


def _window_answers(windows: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for part, docs, many, ranks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                got.setdefault(part, []).append((docs, many, ranks))
        for part in list(got):
            rows = got.pop(part)
            doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(m, np.int32)) for d, m, _ in rows])
            rank = np.concatenate([np.frombuffer(r, U) for _, _, r in rows])
            order, _, least = _own_minimum(rank, doc)
            doc, rank = doc[order], rank[order]
            late = doc > least
            by = np.argsort(doc[late], kind="stable")
            ids, (blobs,) = _packed(doc[late][by], rank[late][by])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "repeated"])

    return windows.repartition(parts, "part").mapInArrow(lean(run), "doc_id long, repeated binary")


def _cut(placed: DataFrame, kept: list[str], length: int, seed: int) -> DataFrame:
    """Last step: covered bytes go. Columns ``kept`` and ``RESULTS``."""
    n = len(kept)
    names = [*kept, *RESULTS]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    key = kept.index("doc_id")

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            ids = batch.column(key)
            settled, opened, repeated = (batch.column(n + j) for j in (1, 2, 3))
            for base, end, texts in unpacked(batch.column(n)):
                out = []
                for lo, hi, data, at in text_chunks(texts, SCAN_BYTES):
                    todo_rows = [i for i in range(lo, hi) if ids[base + i].is_valid and (settled[base + i].is_valid or opened[base + i].is_valid)]
                    s = Sample(data, at, hasher, length, seed) if todo_rows else None
                    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    for i in todo_rows:
                        done, todo = _marked(s, i - lo, settled[base + i].as_py(), opened[base + i].as_py())
                        starts.append(s.lo[done])
                        ends.append(s.hi[done] + length)
                        again = repeated[base + i].as_py()
                        if again and len(todo):
                            start, rank = s.windows(todo)
                            start = start[np.isin(rank, np.concatenate([np.frombuffer(b, U) for b in again]))]
                            starts.append(start)
                            ends.append(start + length)
                    starts, ends = merged(np.concatenate(starts), np.concatenate(ends), at)
                    for i in range(lo, hi):
                        begin, end_ = int(at[i - lo]), int(at[i - lo + 1])
                        gone = slice(*np.searchsorted(starts, [begin, end_]))
                        edges = [begin, *np.column_stack([starts[gone], ends[gone]]).ravel().tolist(), end_]
                        left = b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2]))
                        out.append((end_ - begin, end_ - begin - len(left), len(edges) // 2 - 1, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([c.slice(base, end - base) for c in batch.columns[:n]] + [pa.array([o[j] for o in out], kinds[j]) for j in range(5)], names=names)

    added = zip(names[n:], (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()))
    schema = T.StructType([*placed.select(*kept).schema.fields, *(T.StructField(name, kind) for name, kind in added)])
    return placed.select(*kept, "packed", "settled", "open", "repeated").mapInArrow(lean(run), schema)


def _deduplicated(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, others, ``RESULTS``): ``others`` is a struct of the columns besides doc_id and text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), carried(docs, "others", ("doc_id", "text")), F.col("text").cast("string"))
    texts = rows.select("doc_id", "text").where("doc_id is not null").where(F.octet_length("text") >= length)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(texts) // PARTITION_BYTES))
    found = _answers(_scan(texts, PARTS_PER_PARTITION * parts, length, seed), parts)
    found = stored(found.groupBy("doc_id").agg(F.collect_list("settled").alias("settled"), F.collect_list("open").alias("open")), "repeats-found")
    todo = found.where(F.exists("open", lambda x: F.octet_length(x) > 0))
    windows = _window_parts(packed_texts(texts).join(todo.hint("merge"), "doc_id"), PARTS_PER_PARTITION * parts, length, seed)
    again = _window_answers(windows, parts).groupBy("doc_id").agg(F.collect_list("repeated").alias("repeated"))
    again = stored(again, "repeats-windows")
    placed = packed_texts(rows).join(found.hint("merge"), "doc_id", "left").join(again.hint("merge"), "doc_id", "left")
    return _cut(placed, ["doc_id", "others"], length, seed)


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` without text, with n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A column of ``docs`` that has the name of one of these gives way to it. In kept_text, characters that
    lose some of their bytes are left out whole.
    """
    taken = {"doc_id", "text", *RESULTS}
    others = [F.col("others")[c].alias(c) for c in docs.columns if c.lower() not in taken]
    return _deduplicated(docs, length, seed).select("doc_id", *others, *RESULTS)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text")).drop("kept_text")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, strlen(h) // 2 AS n, i * 512 AS lo, substr(h, i * 1024 + 1, {1022 + 2 * LENGTH}) AS part FROM d, LATERAL (SELECT unnest(range(0, greatest(1, (strlen(h) // 2 + 511) // 512))) AS i)),
w AS (SELECT doc_id, lo + j AS p, substr(part, 2 * j + 1, {2 * LENGTH}) AS s FROM c, LATERAL (SELECT unnest(range(0, 512)) AS j) WHERE lo + j + {LENGTH} <= n),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
k AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.s = w.s AND w.doc_id > f.least),
o AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH}, -1) AS starts FROM k),
g AS (SELECT doc_id, p, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
q AS (SELECT t.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the repeated bytes out of the texts; a document that loses all of its text goes. n_chars follows the text."""
    out = _deduplicated(docs, LENGTH, SEED).where("n_removed = 0 or kept_text <> ''")
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("others")["n_chars"]).alias("n_chars")
    return out.select(*[changed.get(c, F.col("others")[c].alias(c)) for c in docs.columns])
