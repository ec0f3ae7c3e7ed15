"""Toxicity scores after noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (bounded by its alphabet, not by the input).
2. Spans that may be obfuscated become lattices: a leetspeak sign may stand for the letters that
   it imitates, separators between single letters may vanish or end a word, runs of a letter may shrink to
   one or two. Viterbi decoding under the character model picks the restored word. Plain words
   have one path, themselves.
3. Words of restored training texts (near copies of one label count once), and their first 4 to 6 letters, get log odds of toxic against
   other documents, less 1.5 standard errors; the strong ones are the lexicon, whose own
   trigrams join the character model for the decoding that counts.
4. A document's score is a logistic function, fitted on training rows, of the number of its
   distinct lexicon words and of their summed log odds.

Labels are learnt from at most ``SAMPLE_ROWS`` labelled training rows (smallest hashes of
doc_id); three quarters of them make the lexicon, the rest the calibration.

Nulls: a null text is empty and scores like a text without lexicon words. Null labels don't
count. Without both classes, the score is the share of label 1 (0 without labels). Extra columns
are ignored; repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import CHUNK_BYTES, documents, stored, text_chunks
from trunkline.llm.jaccard_join import jaccard_components
from trunkline.llm.quality_gam import held_out, labelled_sample

SAMPLE_ROWS = 20_000
LEAST_DOCUMENTS, LEAST_ODDS = 8, 3.0
STEMS = (4, 5, 6)
THRESHOLD = 0.7
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 3, 1
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Signs and the letters that they imitate (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h"}
LEET_COST, GAP_COST, RUN_COST = -1.5, -0.2, -0.3
WORD = re.compile(r"[^\W\d_]+")
#: Single letters or signs for them set apart, in a whole text; a star is a separator unless separators stand around it. Not \b: "_" is a word character.
APART = re.compile(r"(?:(?<![^\W_])[^\W_]|[@$!|+(#])(?:[ .\-_*]{1,2}(?:[^\W_](?![^\W_])|[@$!|+(#](?![^\W_])|(?<=[ .\-_])\*(?=[ .\-_]))){2,}")
LETTER = re.compile(r"[^\W\d_]")
GAP = frozenset(" .-_*")
NARROW = re.compile(r"[^ .\-_*][ .\-_*][^ .\-_*]")
#: Within a token: signs before letters, a sign at the end, runs.
SUSPECT = re.compile(r"[^\W_]*[0-9@$!|+(*#]+[^\W\d_][\w@$!|+(*#]*|[^\W\d_]+[0-9@$](?![\w@$])|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
REMEMBERED = 300_000
#: SUSPECT takes time in the square of a token's length or worse; in longer tokens whole pieces of letters and signs count as suspect.
LONG_TOKEN = 200
PIECE = re.compile(r"[\w@$!|+(*#]+")
OBFUSCATED = re.compile(r"[0-9@$!|+(*#]|([^\W\d_])\1\1")
#: More than three equal characters decode as three.
RUN = re.compile(r"(.)\1{3,}", re.S)


def _codes() -> np.ndarray:
    """Bytes to symbols: 0 anything that ends a word, 1-26 letters, 27 parts of other letters."""
    table = np.zeros(256, dtype=np.int64)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27
    return table


CODES = _codes()
SYMBOLS = 28


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over every text; 28 ** 3 numbers whatever the input."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, _, data, _ in text_chunks(batch.column(0)):
                for lo in range(0, len(data), CHUNK_BYTES):  # one row may be longer
                    c = CODES[data[lo : lo + CHUNK_BYTES + 2]]
                    if len(c) > 2:
                        total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["code", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for code, n in rows:
        out[code] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def word_trigrams(words: list[str]) -> np.ndarray:
    out = np.zeros((SYMBOLS,) * 3)
    for w in words:
        c = [0, 0, *CODES[np.frombuffer(w.encode(), np.uint8)].tolist(), 0]
        for x, y, z in zip(c, c[1:], c[2:]):
            out[x, y, z] += 1
    return out


def log_model(corpus: np.ndarray, lexicon: np.ndarray | None = None, share: float = 0.5) -> np.ndarray:
    """log P(third | first two), smoothed by the bigram and unigram models; lexicon trigrams mixed in."""

    def conditional(counts):
        uni = counts.sum((0, 1)) + 0.5
        uni = uni / uni.sum()
        bi = (counts.sum(0) + 5 * uni) / (counts.sum((0, 2))[:, None] + 5)
        return (counts + 2 * bi[None]) / (counts.sum(2, keepdims=True) + 2)

    p = conditional(corpus)
    if lexicon is not None and lexicon.sum():
        p = (1 - share) * p + share * conditional(lexicon)
    return np.log(p)


def lattice(span: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each position the outputs (letter or nothing) with their channel costs.

    ``breaks``: words may end (" ") at any gap between letters set apart, and do at a wide one if others are narrow.
    """
    out: list[list[tuple[str, float]]] = []
    last, run = "", 0
    apart = bool(APART.fullmatch(span))
    narrow = bool(NARROW.search(span))
    for i, ch in enumerate(span):
        if apart and ch in " .-_*" and not (ch == "*" and span[i - 1] in " .-_" and span[i + 1 : i + 2] in " .-_"):
            ends = breaks and span[i + 1 : i + 2] not in GAP  # the last separator of its gap
            wide = narrow and span[i - 1] in GAP and not (span[i - 1] == "*" and i > 1 and span[i - 2] in GAP)
            out.append([(" ", GAP_COST)] if ends and wide else [("", GAP_COST), (" ", GAP_COST)] if ends else [("", GAP_COST)])
            continue
        run = run + 1 if ch == last else 1
        last = ch
        if ch in LEET:
            out.append([(x, LEET_COST) for x in LEET[ch]] + ([("", LEET_COST)] if run > 1 or ch in "*!.|" else []))
        elif ch.isalpha():
            out.append([(ch, 0.0)] if run == 1 else [("", RUN_COST)] if run > 2 else [(ch, RUN_COST), ("", RUN_COST)])
        else:
            out.append([("", GAP_COST)])
    return out


def decode(span: str, model: np.ndarray, breaks: bool = False) -> str:
    """Best path through the lattice under the character model, from word start to word end; linear in the span's length."""
    paths: dict = {(0, 0): (0.0, None)}
    for options in lattice(span, breaks):
        grown: dict = {}
        for (x, y), (score, text) in paths.items():
            for letter, cost in options:
                if letter == " ":
                    state, value = (0, 0), score + cost - 1.0 + float(model[x, y, 0])
                elif letter:
                    z = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    state, value = (y, z), score + cost + float(model[x, y, z])
                else:
                    state, value = (x, y), score + cost - 1.0
                if state not in grown or value > grown[state][0]:
                    grown[state] = (value, (text, letter) if letter else text)
        paths = grown
    (_, text), out = max(((score + float(model[x, y, 0]), text) for (x, y), (score, text) in paths.items()), key=lambda p: p[0]), []
    while text:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    """Distinct words of a text, with obfuscated spans restored; remembers the tokens that it has seen."""

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.known = model, {}

    def _restored(self, span: str) -> list[str]:
        whole = decode(span, self.model)
        return [whole, *decode(span, self.model, breaks=True).split()] if APART.fullmatch(span) else [whole]

    def _spans(self, token: str) -> list[str]:
        token = RUN.sub(r"\1\1\1", token)
        if len(token) < LONG_TOKEN:
            return [m.group() for m in SUSPECT.finditer(token)]
        pieces = {part for piece in PIECE.findall(token) for part in (piece, *piece.split("_"))}
        return [piece for piece in pieces if LETTER.search(piece) and OBFUSCATED.search(piece)]

    def _token(self, token: str) -> tuple[str, ...]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = WORD.findall(token)
        for span in self._spans(token):
            got += self._restored(span)
        self.known[token] = tuple(got)
        return self.known[token]

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            got = self.known.get(token)
            out.update(self._token(token) if got is None else got)
        for m in APART.finditer(low):
            if LETTER.search(m.group()):
                for span in {m.group(), m.group().strip(" .-_*@$!|+(#")}:  # signs at the ends may be punctuation
                    out.update(self._restored(span))
        return out


def _one_of_near_copies(joined: DataFrame) -> list[int]:
    """The smallest doc_id of each label in each component of near copies (op8's links: Jaccard of shingles at least 3/4). At most the sample's rows."""
    joined = stored(joined.select("doc_id", "text", "label"), "toxicity-learnt")
    alike = jaccard_components(joined).where("doc_id is not null").select("doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    got = alike.distinct().join(joined.select("doc_id", "label").distinct(), "doc_id")
    return [r[0] for r in got.groupBy("component_id", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct().collect()]


def _word_rows(joined: DataFrame, model: np.ndarray) -> DataFrame:
    """(word, toxic, clean): documents of each class that hold the word, summed within a task first."""

    def run(batches):
        restorer = Restorer(model)
        counts: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["word", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = restorer.words(text or "")
                for w in found | {w[:k] + "~" for w in found for k in STEMS if len(w) > k}:
                    counts.setdefault(w, [0, 0])[int(label == 1)] += 1
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return joined.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _features(found: set[str], lexicon: dict[str, float], stems: dict[str, float]) -> tuple[float, float]:
    """Logarithms of the number of distinct lexicon words and of their summed odds."""
    odds = [lexicon[w] for w in found & lexicon.keys()]
    if stems:
        odds += [max(got) for w in found if w not in lexicon and (got := [stems[w[:k]] for k in STEMS if len(w) > k and w[:k] in stems])]
    return float(np.log1p(len(odds))), float(np.log1p(sum(odds)))


def _rows(frame: DataFrame, model: np.ndarray, lexicon: dict[str, float], extra: str) -> DataFrame:
    """(doc_id, [label,] hits, odds)."""
    names = [*frame.columns[:-1], "hits", "odds"]

    def run(batches):
        restorer = Restorer(model)
        whole = {w: o for w, o in lexicon.items() if w[-1] != "~"}
        stems = {w[:-1]: o for w, o in lexicon.items() if w[-1] == "~"}
        for batch in batches:
            x = [_features(restorer.words(t or ""), whole, stems) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], names=names)

    return frame.mapInArrow(run, f"doc_id long, {extra}hits double, odds double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, training: F.Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    counts = trigram_counts(docs)
    plain = log_model(counts)
    sample = labelled_sample(labels, "toxic", training, rows)
    half = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 3).cast("int")
    size = sample.groupBy("label").count().collect()
    share = {r[0]: r[1] for r in size}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if len([k for k, v in share.items() if v]) < 2:
        level = float(max(share, default=0))
        return texts.select("doc_id", F.lit(level).alias("score"))
    joined = texts.join(F.broadcast(sample), "doc_id")  # at most ``rows`` rows of 12 bytes
    single = docs.sparkSession.createDataFrame([(i,) for i in _one_of_near_copies(joined.where(half == 0))], "doc_id long")
    learnt = joined.join(F.broadcast(single), "doc_id", "left_semi")
    words = _word_rows(learnt.select("text", "label"), plain)
    n = {r[0]: r[1] for r in sample.join(single, "doc_id", "left_semi").groupBy("label").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n.get(0, 0) + 1.0)) - 1.5 * F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    strong = words.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon = {r["word"]: r["odds"] for r in strong.collect()}  # words of LEAST_DOCUMENTS of the sample's documents
    model = log_model(counts, word_trigrams([w for w in lexicon if w[-1] != "~"]))
    fit = sorted(_rows(joined.where(half == 1).select("doc_id", "label", "text"), model, lexicon, "label int, ").collect())
    y = np.array([r[1] for r in fit], dtype=float)
    x = np.array([[r[2], r[3]] for r in fit], dtype=float).reshape(len(fit), 2)
    w = logistic(x, y) if len(fit) else np.zeros(3)
    out = _rows(texts, model, lexicon, "")
    return out.select("doc_id", (1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("hits") + F.lit(float(w[2])) * F.col("odds"))))).alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_of_fit = held_out(HELD_OUT_MODULUS, HELD_OUT_REMAINDER)
    out = toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), ~out_of_fit)
    return out.select("doc_id", F.coalesce(out_of_fit, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
