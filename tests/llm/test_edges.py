"""Clashing names, long texts, small blocks, random event logs, and the whole pipeline, each against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trunkline.llm import chat_format, common, decontaminate, jaccard_join, poisson_mix, quality_gam, suffix_dedup, transport_stream, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets, least=75):
    up = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def removed(rows):
    """{doc_id: kept bytes, removed flags} of the 50-byte rule."""
    seen, out = {}, {}
    for k, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], k) < k:
                cover[p : p + 50] = b"\1" * 50
        out[k] = (bytes(c for c, m in zip(b, cover) if not m), bytes(cover))
    return out


def test_small_blocks_and_many_near_families(spark, monkeypatch):
    """Chains of texts at similarities around the threshold: families of several blocks, buckets of several cuts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(11)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(40)]
        for i in range(40):
            base = [w if rng.random() > 0.06 else f"r{rng.randrange(10**6)}" for w in base]
            rows.append((family * 100 + i, " ".join(base[: rng.randrange(30, 41)])))
    sets = {k: set(t.split()) for k, t in rows}
    up = components(sets)
    assert 10 < len(set(up.values())) < 110
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert {r.doc_id: r.component_id for r in got} == up


CLASH = ["copy", "place", "rate", "rate_source", "n_copies", "__mix_rate2", "settled", "open", "packed", "repeated", "n_bytes", "n_removed", "kept_text", "others", "digest", "rep", "key", "component", "a.b"]


def clashing(spark, rows):
    frame = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def test_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared = text(30)
    rows = [(1, text(40)), (2, shared + " " + text(20)), (3, text(10) + " " + shared), (4, None), (5, ""), (6, text(60))]
    docs = clashing(spark, rows)
    mixed = poisson_mix.mixed(docs)
    assert set(mixed.columns) == {*docs.columns, "copy", "place"}
    assert all(r["rate"] == "own rate" and r["settled"] == "own settled" and isinstance(r["copy"], int) for r in mixed.collect())
    cut = removed(rows)
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert {k: (r["kept_text"].encode(), r["n_removed"], r["settled"], r["a.b"]) for k, r in got.items()} == {k: (left, sum(c), "own settled", "own a.b") for k, (left, c) in cut.items()}
    staged = suffix_dedup.stage(spark, docs, "")
    assert staged.columns == docs.columns and {r["n_bytes"] for r in staged.collect()} == {"own n_bytes"}
    assert jaccard_join.stage(spark, docs, "").columns == docs.columns
    spark.createDataFrame([(1, shared)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = decontaminate.stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 4, 5, 6}
    assert transport_stream.media_column(docs).count() == 6


def test_clashing_columns_of_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (2, "http://b.org/", "x"), (2, "http://b.org/", "x")], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit("own").alias(c) for c in ("sha", "first", "refers_to", "shard", "sort_key", "host", "pattern", "history", "active")])
    folder = warc.fresh_path(spark, "warc")
    captures = warc.write_archives(warc.deduplicated(pages), folder)
    got = warc.read_captures(pages, warc.write_index(captures, folder), record_bytes=1 << 28).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
    day = F.lit("2024-01-01").cast("date")
    entries = spark.createDataFrame([("a.org", "x")], "pattern string, category string").select("*", day.alias("day"), F.lit("add").alias("action"), F.lit("own").alias("history"))
    out = url_filters.filtered(pages.withColumn("fetched_on", day), entries).collect()
    assert {(r.page_id, r.blocked) for r in out} == {(1, True), (2, False)}
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(c) for c in ("item", "seq", "at", "log", "base", "parts")])
    assert len(chat_format.parsed(chat_format.formatted(chat_format.folded(chat_format.conversation_events(rows)))).first().turns) == 2


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.fresh_path(spark, "warc")
    shards = warc.write_index(warc.write_archives(warc.deduplicated(pages), folder), folder)
    assert warc.read_captures(pages, shards).count() == 0
    events = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.parsed(chat_format.formatted(chat_format.folded(chat_format.conversation_events(events)))).count() == 0
    day = F.lit("2024-01-01").cast("date")
    assert url_filters.filtered(pages.withColumn("fetched_on", day), pages.selectExpr("url AS pattern", "url AS category", "html AS action").withColumn("day", day)).count() == 0
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_gam.scored(docs, quality_gam.fitted(docs, labels, F.lit(True))).count() == 0
    assert decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def folded_by_hand(events):
    out = {}
    for conv in {e[0] for e in events}:
        mine = [e for e in events if e[0] == conv]
        for turn in {e[2] for e in mine}:
            again = max((e[1] for e in mine if e[3] == "regenerate" and e[2] <= turn), default=-1)
            own = sorted((e[1], e[3], e[4], e[5]) for e in mine if e[2] == turn and e[1] >= again)
            base = max((e[0] for e in own if e[1] in ("edit", "regenerate")), default=-1)
            if own:
                out[conv, turn] = (own[0][2], "".join(e[3] for e in own if e[0] >= base))
    return out


def test_random_event_logs(spark):
    rng = random.Random(6)
    events = []
    for conv in range(30):
        for seq in range(rng.randrange(1, 25)):
            op = rng.choice(["delta"] * 5 + ["edit", "regenerate"])
            events.append((conv, seq, rng.randrange(4), op, rng.choice(["user", "assistant"]), rng.choice(["", "a", "</s>", "bc", "<|im_end|>", "\\"])))
    frame = spark.createDataFrame(events, "conv_id long, seq long, turn long, op string, role string, text string")
    messages = chat_format.folded(frame)
    want = folded_by_hand(events)
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in messages.collect()} == want
    for r in chat_format.parsed(chat_format.formatted(messages)).collect():
        turns = [want[c, t] for c, t in sorted(want) if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(x for role, x in turns if role == "assistant")


def test_deltas_put_together(spark):
    text = "ab😀\ncd" * 50
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", None), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    events = chat_format.conversation_events(rows, size=7)
    assert events.count() > 40
    assert {r.turn: r.text for r in chat_format.folded(events).collect()} == {0: text, 1: "", 2: ""}


def test_media_columns_of_every_row(spark):
    texts = [None, "", "x", "é" * 40, "y" * 5000, "y" * 5000, "z" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in transport_stream.media_features(transport_stream.media_column(docs)).collect():
        b = (texts[r.doc_id] or "").encode()
        padded = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        stream = transport_stream.mux(padded)
        units = -(-len(padded) // 4096)
        access = ",".join(str(i) for i in range(0, units, 8))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert r.feature == f"packets={len(stream) // 188};units={units};breaks=0;access={access};last={(units - 1) * 3600 / 90000:.2f}"
        assert r.stamps == [3600 * i for i in range(units)] and r.access_stamps == r.stamps[::8]


def test_long_texts_in_pieces(monkeypatch):
    """Words, lines and chosen positions of a text are the same, in whatever pieces it is read."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abé\n") for _ in range(rng.choice([1, 3, 8, 90, 700]))) for _ in range(300)).encode()
    hasher = common.ByteHasher()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    words = common.word_hashes(data, at, hasher)[0]
    sample = suffix_dedup.Sample(data, at, hasher, 50, 20)
    windows = sample.windows(np.arange(len(sample.lo)))
    features = quality_gam.text_features(pa.array([text], pa.binary()), hasher)
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 300)
    cut = suffix_dedup.Sample(data, at, hasher, 50, 20)
    assert all(np.array_equal(getattr(sample, f), getattr(cut, f)) for f in ("row", "lo", "hi", "seed", "wide"))
    assert all(np.array_equal(x, y) for x, y in zip(windows, cut.windows(np.arange(len(cut.lo)))))
    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    monkeypatch.setattr(quality_gam, "CHUNK_BYTES", 2000)
    assert b"".join(p.tobytes() for p in common.word_pieces(data, 200)) == text
    assert np.array_equal(words, common.word_hashes(data, at, hasher)[0])
    assert np.allclose(features, quality_gam.text_features(pa.array([text], pa.binary()), hasher))


def test_unlike_words_that_agree_under_polynomials():
    morse = [0]
    while len(morse) < 2048:
        morse += [1 - x for x in morse]
    pair = [bytes(97 + (x ^ flip) for x in morse) for flip in (0, 1)]
    a, b = common.shingle_sets(pa.array(pair, pa.binary()), common.ByteHasher())
    assert a != b


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination_paths_agree(spark, bound):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i % 9, text(rng.choice([3, 8, 20, 60]))) for i in range(12)]
    docs = [(i % 30 if i % 7 else None, text(20) + " " + rng.choice(items)[1] + " " + text(rng.choice([0, 30, 800]))) for i in range(40)] + [(99, None), (98, "")]
    want = sorted(((d, i, len(q), len(q & shingles(t))) for d, t in docs for i, x in items if (q := shingles(x)) and 4 * len(q & shingles(t)) >= 3 * len(q)), key=repr)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_shingles=bound)
    assert sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got.collect()), key=repr) == want


def score_by_hand(model, x):
    """The model's score of one line of features, entry by entry."""
    if model.constant is not None:
        return model.constant
    bins = [sum(v >= c for c in cuts) for v, cuts in zip(x, model.cuts)]
    total = model.base + sum(t[b] for b, t in zip(bins, model.tables))
    coarse = [b * quality_gam.PAIR_BINS // (len(c) + 1) for b, c in zip(bins, model.cuts)]
    return 1 / (1 + np.exp(-total - sum(t[coarse[a], coarse[b]] for a, b, t in model.pairs)))


def poisson_copies(doc_id, rate):
    unit = int(hashlib.md5(f"{poisson_mix.SEED}|{doc_id}".encode()).hexdigest()[:8], 16) / 2**32
    p = c = np.exp(-rate)
    k = 0
    while unit >= c and k < 200:
        k += 1
        p *= rate / k
        c += p
    return k


def test_pipeline_against_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, items = text(30), [(0, text(30)), (1, text(40))]
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        body = " ".join([rng.choice(words[:3])] * 60) + f" {i}" * 3 if bad else text(rng.randrange(30, 80))
        rows.append((i, body))
        labels.append((i, int(not bad), 0))
    for i in range(160, 200):
        body = rows[rng.choice([j for j in range(1, 160) if j % 4])][1]
        rows.append((i, [body, body + " " + text(3), text(30) + " " + passage + " " + text(10), text(40) + " " + rng.choice(items)[1] + " " + text(40)][i % 4]))
    rows += [(300, None), (301, "")]
    docs = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, t in rows]
    for name, table, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy", "place"}

    train = ~quality_gam.held_out(quality_gam.HELD_OUT_MODULUS, quality_gam.HELD_OUT_REMAINDER)
    model = quality_gam.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), train)
    hasher = common.ByteHasher()
    keep = [r for r in docs if score_by_hand(model, quality_gam.text_features(pa.array([r[1] or ""]), hasher)[0]) >= quality_gam.THRESHOLD]
    assert 100 < len(keep) < 180
    up = components({r[0]: shingles(r[1]) for r in keep})
    keep = [r for r in keep if up[r[0]] == r[0]]
    cut = removed([(r[0], r[1]) for r in keep])
    keep = [(r[0], left.decode(), r[2], r[3], len(left.decode()) if any(c) else r[4]) for r in keep for left, c in [cut[r[0]]] if left or not any(c)]
    assert any(c[0] != (dict(rows)[k] or "").encode() for k, c in cut.items())
    sets = [s for _, x in items if (s := shingles(x))]
    before = len(keep)
    keep = [r for r in keep if not any(4 * len(s & shingles(r[1])) >= 3 * len(s) for s in sets)]
    assert len(keep) < before
    sizes = {}
    for r in keep:
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    total = sum(n**poisson_mix.TEMPERATURE for n in sizes.values())
    rate = {s: round(n**poisson_mix.TEMPERATURE / total * len(keep) / n, 6) for s, n in sizes.items()}
    want = sorted((*r, c) for r in keep for c in range(poisson_copies(r[0], rate[r[3]])))
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy) for r in got.collect()) == want


@pytest.mark.parametrize("length", [5, 7, 20, 50])
def test_prefix_doubling_equals_sampled_positions(spark, length):
    from trunkline.llm.prefix_doubling import repeated_windows

    rng = random.Random(length)
    shared = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (30, 60, 90)]
    rows = [(i % 25, rng.choice(shared) + "".join(rng.choice("abcé ") for _ in range(rng.randrange(40))) + rng.choice(shared)) for i in range(30)] + [(40, None), (41, ""), (None, shared[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, want = {}, set()
    for k, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], k) < k:
                want.add((k, p))
    assert {tuple(r) for r in repeated_windows(docs, length).collect()} == want


def best_paths(span, model, breaks):
    """Texts of all best paths through the lattice, by trying every path."""
    import itertools

    from trunkline.llm.toxicity import lattice

    scored = []
    for path in itertools.product(*lattice(span, breaks)):
        x = y = 0
        score, out = 0.0, ""
        for letter, cost in path:
            score += cost
            if letter == " ":
                score += model[x, y, 0] - 1.0
                x = y = 0
            elif letter:
                z = ord(letter) - 96 if "a" <= letter <= "z" else 27
                score += model[x, y, z]
                x, y = y, z
            else:
                score -= 1.0
            out += letter
        scored.append((score + model[x, y, 0], out))
    top = max(s for s, _ in scored)
    return {out for s, out in scored if s > top - 1e-9}


def test_decoder_against_all_paths():
    from trunkline.llm import toxicity

    model = toxicity.log_model(toxicity.word_trigrams("you are a stupid idiot go away now please".split() * 20))
    rng = random.Random(13)
    spans = ["1d10t", "s t u p", "i.d-1_0", "st00pid", "aaa", "$$", "é1!", "*a*"] + ["".join(rng.choice("iodtsaue10$!* .") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    for span in spans:
        for breaks in (False, True):
            assert toxicity.decode(span, model, breaks) in best_paths(span, model, breaks), span
