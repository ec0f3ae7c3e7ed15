"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Cyclic boosting fits one shallow tree a
feature and round to the logistic gradient and adds it to the feature's lookup table; then the
pairs of features with the largest remaining gain get tables of their own in the same way.
A score is the sigmoid of the sum of the tables' entries: vectorised bin additions.

Labels are learnt from at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of
doc_id, from the training part of the split only. Scoring is one pass without a shuffle.

Nulls: a null text is empty and gets a score like any other. Labels that are null don't count;
of several labels of one doc_id the largest counts. Without both classes among the labels, every
score is the share of label 1 (0.5 without any labels). Extra columns are ignored, whatever their names; an empty table
gives no rows, repeated rows score alike, and a very long text is read in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import CHUNK_BYTES, ByteHasher, digest64, documents, lean, stored, text_chunks, word_hashes

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS = 120, 60
PAIRS = 6
RATE = 0.15
THRESHOLD = 0.3
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 0
FEATURES = [
    "log_words", "word_length", "distinct_words", "top_word", "upper", "symbols", "digits", "marks", "non_ascii", "spaces",
    "repeated_triples", "same_next_word", "log_lines", "line_words", "repeated_lines", "entropy", "exclamations", "capital_words", "long_words",
]


def _classes() -> np.ndarray:
    """Per byte: 0 lower, 1 upper, 2 digit, 3 . , 4 space, 5 line end, 6 beyond ASCII, 7 !, 8 other."""
    kind = np.full(256, 8, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 6
    kind[[46, 44]], kind[[32, 9, 11, 12, 13]], kind[10], kind[33] = 3, 4, 5, 7
    return kind


KIND = _classes()


def byte_counts(data: np.ndarray) -> np.ndarray:
    """How often each byte stands in ``data``, a chunk at a time."""
    total = np.zeros(256, dtype=np.int64)
    for lo in range(0, len(data), CHUNK_BYTES):
        total += np.bincount(data[lo : lo + CHUNK_BYTES], minlength=256)
    return total


def line_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hasher: ByteHasher) -> np.ndarray:
    """Hash of each line [begin, end); lines are read a chunk at a time, longer ones by BLAKE2b."""
    out, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        if end[i] - begin[i] > CHUNK_BYTES:
            out[i] = digest64(data[begin[i] : end[i]])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK_BYTES, side="right")))
        out[i:j] = hasher.spans(hasher.prefix(data[begin[i] : end[j - 1]]), begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return out


def text_features(column: pa.Array, hasher: ByteHasher) -> np.ndarray:
    """One line of ``FEATURES`` for each row."""
    blocks = [np.zeros((0, len(FEATURES)))]
    for lo, hi, data, at in text_chunks(column):
        rows = hi - lo
        size = np.maximum(np.diff(at), 1).astype(float)
        hist = np.stack([byte_counts(data[a:b]) for a, b in zip(at, at[1:])])
        share = np.stack([hist[:, KIND == k].sum(1) for k in range(9)]).astype(float)
        words, row = word_hashes(data, at, hasher)
        n_words = np.bincount(row, minlength=rows).astype(float)
        cut = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        lines = np.flatnonzero(data == 10)
        out = np.zeros((rows, len(FEATURES)))
        letters = np.maximum(share[0] + share[1] + share[6] / 2, 1)
        some = np.maximum(n_words, 1)
        black = size - share[4] - share[5]
        out[:, 0] = np.log1p(n_words)
        out[:, 1] = black / some
        out[:, 4] = share[1] / letters
        out[:, 5], out[:, 6], out[:, 7], out[:, 8], out[:, 9] = share[8] / size, share[2] / size, share[3] / size, share[6] / size, share[4] / size
        out[:, 12] = np.log1p(share[5])
        out[:, 13] = n_words / (share[5] + 1)
        out[:, 16] = share[7] / some
        out[:, 17] = share[1] / some
        for i in range(rows):
            own = words[cut[i] : cut[i + 1]]
            if not len(own):
                continue
            counts = np.unique(own, return_counts=True)[1]
            out[i, 2], out[i, 3] = len(counts) / len(own), counts.max() / len(own)
            if len(own) > 3:
                triples = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
                out[i, 10] = 1 - len(np.unique(triples)) / len(triples)
                out[i, 11] = float((own[1:] == own[:-1]).mean())
            ends = lines[np.searchsorted(lines, at[i]) : np.searchsorted(lines, at[i + 1])]
            begin, end = np.concatenate([[at[i]], ends + 1]), np.concatenate([ends, [at[i + 1]]])
            full = end - begin > 3
            if full.any():
                out[i, 14] = 1 - len(np.unique(line_hashes(data, begin[full], end[full], hasher))) / full.sum()
            p = hist[i][hist[i] > 0] / hist[i].sum()
            out[i, 15] = -(p * np.log2(p)).sum()
            out[i, 18] = float((at[i + 1] - at[i]) / len(own) > 12)
        blocks.append(out)
    return np.concatenate(blocks)


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins: each segment is split where the gain is largest, ``depth`` times over."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    out = np.zeros(len(grad))
    segments = [(0, len(grad), depth)]
    while segments:
        s, e, left = segments.pop()
        best, where = 1e-6, 0
        if left and e - s > 1:
            k = np.arange(s + 1, e)
            gain = (g[k] - g[s]) ** 2 / (h[k] - h[s] + 1) + (g[e] - g[k]) ** 2 / (h[e] - h[k] + 1) - (g[e] - g[s]) ** 2 / (h[e] - h[s] + 1)
            if gain.max() > best:
                where = int(k[gain.argmax()])
        if where:
            segments += [(s, where, left - 1), (where, e, left - 1)]
        else:
            out[s:e] = (g[e] - g[s]) / (h[e] - h[s] + 1)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree of one split on each of two features over a grid of bins: four leaves; and its gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    n, m = grad.shape
    best, table = 0.0, np.zeros((n, m))
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            sums = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in cells]
            gain = sum(x * x / (y + 1) for x, y in sums)
            if gain > best:
                best, table = gain, np.zeros((n, m))
                for (a, b, c, d), (x, y) in zip(cells, sums):
                    table[a:b, c:d] = x / (y + 1)
    return table, best


class Gam:
    """Lookup tables of features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        share = float(y.mean()) if len(y) else 0.5
        self.constant = share if share in (0.0, 1.0) or not len(y) else None
        self.cuts, self.tables, self.pairs = [], [], []
        if self.constant is not None:
            return
        self.base = float(np.log(share / (1 - share)))
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], inner)) for j in range(x.shape[1])]
        bins = self.binned(x)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        total = np.full(len(y), self.base)

        def slope():
            p = 1 / (1 + np.exp(-total))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                g, h = slope()
                tree = RATE * _shallow_tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
                table += tree
                total += tree[bins[j]]
        coarse = [(b * PAIR_BINS) // (len(c) + 1) for b, c in zip(bins, self.cuts)]
        g, h = slope()
        grid = lambda a, b, w: np.bincount(coarse[a] * PAIR_BINS + coarse[b], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gains = {(a, b): _pair_tree(grid(a, b, g), grid(a, b, h))[1] for a in range(len(bins)) for b in range(a + 1, len(bins))}
        chosen = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
        tables = {k: np.zeros((PAIR_BINS, PAIR_BINS)) for k in chosen}
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in tables.items():
                g, h = slope()
                tree = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[0]
                table += tree
                total += tree[coarse[a], coarse[b]]
        self.pairs = [(a, b, t) for (a, b), t in tables.items()]

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins = self.binned(x)
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            total += t[b]
        coarse = [(b * PAIR_BINS) // (len(c) + 1) for b, c in zip(bins, self.cuts)]
        for a, b, t in self.pairs:
            total += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def held_out(modulus: int, remainder: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def labelled_sample(labels: DataFrame, column: str, training: F.Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``rows`` training rows, by the smallest hashes of doc_id."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & training)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    return stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled-sample")


def fitted(docs: DataFrame, labels: DataFrame, training: F.Column, rows: int = SAMPLE_ROWS) -> Gam:
    sample = labelled_sample(labels, "quality", training, rows)
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows of 12 bytes

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            x = text_features(batch.column(1), hasher)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sorted(joined.mapInArrow(lean(run), "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return Gam(x, np.array([r[1] for r in got], dtype=float))


def scored(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) for each row."""

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(text_features(batch.column(1), hasher)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out_of_fit = held_out(HELD_OUT_MODULUS, HELD_OUT_REMAINDER)
    model = fitted(docs, documents(spark, sf_dir, "labels"), ~out_of_fit)
    return scored(docs, model).select("doc_id", F.coalesce(out_of_fit, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, documents(spark, sf_dir), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects; scoring rides on the rows, so nothing is joined."""
    model = fitted(docs, documents(spark, sf_dir, "labels"), ~held_out(HELD_OUT_MODULUS, HELD_OUT_REMAINDER))
    at = docs.columns.index("text")

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            yield batch.filter(pa.array(model.score(text_features(batch.column(at).cast(pa.string()), hasher)) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
