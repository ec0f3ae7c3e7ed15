"""Shared helpers: shared-folder tables, byte hashing, word shingles, components."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Multiplier of the polynomial hash over bytes; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once by the vectorised scanners.
CHUNK_BYTES = 1 << 20
#: Words of more bytes are hashed by BLAKE2b: strings of 1,024 bytes can be made that agree under any polynomial modulo 2**64.
LONG_WORD = 64
#: Salts of joins with a side whose key may be one node for a great part of all rows.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where it is unset, a session on a local master gets a folder of its own; any other
    master is an error, because machine-local folders are not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trunkline-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trunkline/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- memory of Python workers

#: Bytes of an Arrow batch of whole texts, unless the session sets its own: a batch stands in Python and outside the JVM's heap.
BATCH_BYTES = "8m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES where the session leaves the setting alone (its default is 64 MB)."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system; allocators otherwise keep a worker's peak for as long as it waits for tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving memory back when its task ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


# ---------------------------------------------------------------- byte hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class ByteHasher:
    """Polynomial hashes of any spans of a byte buffer, modulo 2**64, through one prefix sum."""

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
        self.power = np.ones(1, dtype=U)
        self.inverse = np.ones(1, dtype=U)

    def _reach(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            for name, base in (("power", BASE), ("inverse", BASE_INVERSE)):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data))
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal bytes give equal values wherever they stand."""
        return mix64((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them); null counts as empty.

    Each piece holds whole rows, of about ``limit`` bytes together unless one row is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, last, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def packed_texts(frame: DataFrame) -> DataFrame:
    """``frame`` with its last column, ``text``, as Zstandard frames: half of what the shuffle's own codec leaves."""
    kept = frame.drop("text")

    def run(batches):
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3)
        for batch in batches:
            last = batch.num_columns - 1
            texts = [None if t is None else press.compress(t) for t in batch.column(last).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "packed"])

    schema = T.StructType([*kept.schema.fields, T.StructField("packed", T.BinaryType())])
    return frame.select(*kept.columns, F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def unpacked(column: pa.Array, piece: int = 8 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, last row + 1, texts) of a column of Zstandard frames, about ``piece`` text bytes at a time; null stays null."""
    from zstandard import ZstdDecompressor

    loose = ZstdDecompressor()
    held, size, first = [], 0, 0
    for i, blob in enumerate(column):
        text = None if not blob.is_valid else loose.decompress(blob.as_py())
        held.append(text)
        size += len(text or b"")
        if size >= piece:
            yield first, i + 1, pa.array(held, pa.large_binary())
            held, size, first = [], 0, i + 1
    if held:
        yield first, first + len(held), pa.array(held, pa.large_binary())


# ---------------------------------------------------------------- words and shingles


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


LOWER, SPACE = lower_table(), space_table()


def digest64(data: np.ndarray) -> int:
    """BLAKE2b of lower-cased bytes, a chunk at a time."""
    h = hashlib.blake2b(digest_size=8)
    for lo in range(0, len(data), CHUNK_BYTES):
        h.update(LOWER[data[lo : lo + CHUNK_BYTES]].tobytes())
    return int.from_bytes(h.digest(), "little")


def word_pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """``data`` cut after spaces into pieces of ``limit`` bytes at most; a longer word is a piece of its own."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        spaces = np.flatnonzero(SPACE[data[lo:hi]]) if hi < len(data) else None
        if spaces is not None:
            if len(spaces):
                hi = lo + int(spaces[-1]) + 1
            else:
                while hi < len(data) and not SPACE[data[hi : hi + limit]].any():
                    hi = min(hi + limit, len(data))
                hi += int(SPACE[data[hi : hi + limit]].argmax()) if hi < len(data) else 0
        yield data[lo:hi]
        lo = hi


def word_hashes(data: np.ndarray, at: np.ndarray, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and the index of its row.

    A single row beyond ``CHUNK_BYTES`` is read in pieces, so that the arrays over its bytes stay small.
    """
    if len(data) > CHUNK_BYTES and len(at) == 2:
        got = [_long_word(piece) if len(piece) > CHUNK_BYTES else _word_hashes(piece, np.array([0, len(piece)]), hasher)[0] for piece in word_pieces(data, CHUNK_BYTES)]
        words = np.concatenate(got)
        return words, np.zeros(len(words), np.int64)
    return _word_hashes(data, at, hasher)


def _long_word(piece: np.ndarray) -> np.ndarray:
    return np.array([digest64(piece)], dtype=U)


def _word_hashes(data: np.ndarray, at: np.ndarray, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= first[1:] | ~word[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = hasher.spans(hasher.prefix(LOWER[data]), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = digest64(data[start[i] : end[i]])
    return hashes, np.searchsorted(at, start, side="right") - 1


def word_shingles(data: np.ndarray, at: np.ndarray, hasher: ByteHasher, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles in text order with row indices; a row of fewer words gives its whole sequence as one."""
    words, row = word_hashes(data, at, hasher)
    n = len(words)
    if n == 0:
        return words, row
    step = U(0x9FB21C651E98DF25)
    whole = max(n - size + 1, 0)
    acc = np.zeros(whole, dtype=U)
    for i in range(size):
        acc = mix64(acc * step + words[i : i + whole])
    same = row[:whole] == row[size - 1 :] if whole else np.zeros(0, bool)
    counts = np.bincount(row, minlength=len(at) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return acc[same], row[:whole][same]
    begin = np.concatenate([[0], np.cumsum(counts)])
    extra = np.zeros(len(short), dtype=U)
    for j, r in enumerate(short):
        x = np.array([counts[r] + 1], dtype=U)
        for w in words[begin[r] : begin[r] + counts[r]]:
            x = mix64(x * step + w)
        extra[j] = x[0]
    hashes, rows = np.concatenate([acc[same], extra]), np.concatenate([row[:whole][same], short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def shingle_sets(column: pa.Array, hasher: ByteHasher, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    for lo, hi, data, at in text_chunks(column):
        hashes, rows = word_shingles(data, at, hasher, size)
        cut = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(hashes[cut[i] : cut[i + 1]])


def grouped_frames(frames: Iterable, keys: list[str]) -> Iterator:
    """Whole groups, as pandas frames, from partitions sorted by ``keys``; a group may cross batches."""
    import pandas as pd

    held = []
    held_key = None
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame), dtype=bool)
        change[0] = True
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], len(frame)]):
            key = tuple(v[s] for v in values)
            if held and key != held_key:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(frame.iloc[s:e])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


# ---------------------------------------------------------------- connected components


def _salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; rows of ``left`` that share a key are dealt over ``SALTS`` tasks by column ``by``."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [key, "salt"], how).drop("salt")  # sizes are estimated without the copies


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b): label is the smallest id reachable.

    Rounds of contraction: every node points at its smallest neighbour, pointers are doubled
    twice, edges move to the ends' targets, loops and repeats go. Each round is a written
    table; nothing but its row count reaches the driver. Group-bys combine before the shuffle;
    joins by a node that may be the target of most rows are salted.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
        near = both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        for _ in range(2):
            hop = near.select(F.col("id").alias("to"), F.col("to").alias("next"))
            near = _salted(near, hop, "to", "id").select("id", F.col("next").alias("to"))
        near = stored(near, f"{name}-level{len(levels)}")
        levels.append(near)
        moved = _salted(edges, near.select(F.col("id").alias("a"), F.col("to").alias("x")), "a", "b")
        moved = _salted(moved, near.select(F.col("id").alias("b"), F.col("to").alias("y")), "b", "a")
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(moved, f"{name}-edges")
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = levels[0].withColumnRenamed("to", "label")
    for level in levels[1:]:
        step = level.select(F.col("id").alias("label"), F.col("to").alias("next"))
        out = _salted(out, step, "label", "id", "left").select("id", F.coalesce("next", "label").alias("label"))
    return out


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, name: str, but: tuple[str, ...] = ()) -> F.Column:
    """All columns of ``docs`` but some as one struct, so that no name clashes with those of an operator; null if none is left."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in but]
    return (F.struct(*others) if others else F.lit(None).cast("string")).alias(name)


def text_bytes(texts: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass over one column, to choose the number of partitions by."""
    return int(texts.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0)
