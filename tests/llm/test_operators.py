"""Operators on small tables with nulls, empty and repeated texts, clashing extra columns, and none at all."""

import hashlib
import random
import re

import pytest

from trunkline.llm import chat_format, decontaminate, jaccard_join, poisson_mix, quality_gam, suffix_dedup, toxicity, transport_stream, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéz") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared = text(60), text(25)
    texts = [base, base, base + " tail", base.upper(), None, "", "   ", "one two", "ONE two", shared + " " + text(40), text(30) + " " + shared, text(3000), shared, "a" * 300, "a" * 120, "x"]
    texts += [base.replace(" ", "  ", 3) + f" {i}" for i in range(12)] + [text(rng.randrange(80)) for _ in range(30)]
    return [(i, t, "en", "s0" if i % 3 else None, len(t or ""), "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    up = {k: k for k in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    assert got == {k: (len(s), up[k]) for k, s in sets.items()}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_links_pairs_among_texts_that_share_their_words(spark):
    """Each common bucket of a linked pair has some other smallest member, a different one nearly every time."""
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for p in range(3):
        common = text(200)
        rows += [(p * 10_000 + i, " ".join(rng.sample(common, 60))) for i in range(1000)]
        rows += [(p * 10_000 + 5000 + i, " ".join(common + text(27))) for i in (0, 1)]
    sets = {k: set(t.split()) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b < a + 10_000 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links == [(p * 10_000 + 5000, p * 10_000 + 5001) for p in range(3)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: dict((b, a) for a, b in links).get(k, k) for k in sets}


def test_tree_links_equal_brute_force():
    import numpy as np

    rng = random.Random(1)
    for _ in range(20):
        pool = [rng.getrandbits(64) for _ in range(60)]
        sets = [np.unique(np.array(rng.sample(pool, rng.randrange(40, 60)), dtype=np.uint64)) for _ in range(25)]
        found = jaccard_join.tree_links(sets, list(range(25)), None, list(range(25)))
        up, want = list(range(25)), list(range(25))
        for links, label in ((found, up), ([(i, j) for i in range(25) for j in range(i) if 7 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 3 * (len(sets[i]) + len(sets[j]))], want)):
            for _ in range(25):
                for i, j in links:
                    label[i] = label[j] = min(label[i], label[j])
        assert up == want


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect()}
    seen, want = {}, {}
    for k, text, *_ in corpus():
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if seen.setdefault(w, k) < k:
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, cover) if not m)
        want[k] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    assert got == want
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    texts = dict((r[0], r[1]) for r in corpus())
    items = [(0, texts[12]), (1, None), (2, ""), (3, "one two"), (4, "not there at all in any text"), (5, " ".join(texts[11].split()[100:150]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i): (len(q), len(q & shingles(t))) for k, t in texts.items() for i, x in items if (q := shingles(x)) and 4 * len(q & shingles(t)) >= 3 * len(q)}
    for bound in (1_000_000, 0):
        got = decontaminate.contaminated(docs, table, broadcast_shingles=bound).collect()
        assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == want
    assert decontaminate.contaminated(empty, table).count() == 0


def test_poisson_mix(docs, empty):
    got = poisson_mix.mixed(docs, {"s0": 3.0, None: 1.0}).collect()
    assert set(got[0].__fields__) == {*docs.columns, "copy", "place"}
    many = poisson_mix.mixed(docs.sparkSession.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 4 = 0, 'a', 'b') AS source"), {"a": 0.5, "b": 0.5})
    share = {r[0]: r[1] for r in many.groupBy("source").count().collect()}
    assert abs(share["a"] - 10_000) < 400 and abs(share["b"] - 10_000) < 400
    assert poisson_mix.mixed(empty).count() == 0


def test_transport_stream(docs, empty):
    for n in (0, 1, 63, 64, 167, 168, 169, 184, 4096, 4097, 100_000):
        data = random.Random(n).randbytes(n)
        got = transport_stream.demux(transport_stream.mux(data))
        assert got["payload"] == data and got["breaks"] == 0
        assert got["stamps"] == [i * transport_stream.UNIT_TICKS for i in range(got["units"])]
        assert got["access"] == list(range(0, got["units"], transport_stream.RANDOM_ACCESS_EVERY))
    stream = bytearray(transport_stream.mux(b"x" * 5000))
    del stream[188 * 5 : 188 * 6]
    assert transport_stream.demux(bytes(stream))["breaks"] == 1
    rows = transport_stream.media_features(transport_stream.media_column(docs)).collect()
    for r, (_, text, *_) in zip(sorted(rows), corpus()):
        b = (text or "").encode()
        padded = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())
    assert transport_stream.media_column(empty).count() == 0


def test_chat_events(spark):
    ev = [
        ("c", 1, 0, "delta", "user", "hel"), ("c", 2, 0, "delta", "user", "lo"), ("c", 3, 1, "delta", "assistant", "bad"), ("c", 4, 2, "delta", "user", "gone"),
        ("c", 5, 1, "regenerate", "assistant", "go"), ("c", 6, 1, "delta", "assistant", "od"), ("c", 7, 0, "edit", "user", "hi"), (None, 1, 0, "delta", None, None),
    ]
    frame = spark.createDataFrame(ev, "conv_id string, seq long, turn long, op string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.folded(frame).collect()}
    assert got == {("c", 0): ("user", "hi"), ("c", 1): ("assistant", "good"), (None, 0): ("", "")}
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>user\n", r"[\INST] [\\INST]", "", "<<SYS>>\\", "a😀</s>"]
    rows = spark.createDataFrame([(1, i, "assistant", t, "x") for i, t in enumerate(nasty)], "conv_id long, turn long, role string, text string, seq string")
    r = chat_format.parsed(chat_format.formatted(chat_format.folded(chat_format.conversation_events(rows)))).first()
    assert [t.text for t in r.turns] == nasty and r.loss_text == "".join(nasty)
    assert not re.search(r"</s>|\[INST\]", r.formatted)


def test_warc(spark):
    rows = [(5, "http://a.org/x", "same"), (3, "http://b.org/", "same"), (7, None, None), (8, "bad url", ""), (9, "http://a.org/x", "é" * 5000), (9, "http://a.org/x", "é" * 5000), (None, "http://c.org", "same")]
    rows += [(100 + i, f"http://h{i % 3}.org/p", f"text {i % 7}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.fresh_path(spark, "warc")
    shards = warc.write_index(warc.write_archives(warc.deduplicated(pages), folder, archive_bytes=2000), folder, block_lines=4)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_captures(pages, shards).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = [(i, warc.digest32((h or "").encode()), "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""]) for i, _, h in rows]
    assert got == sorted(want, key=repr)


def test_url_filters(spark):
    import datetime as d

    day = d.date(2024, 1, 1).replace
    events = [("a.org", "x", day(day=2), "add"), ("a.org", "x", day(day=5), "remove"), ("a.org", "x", day(day=9), "add"), ("b.org/p", None, day(day=1), "add"), ("c.org", "y", day(day=1), "add"), ("c.org", "y", day(day=1), "remove"), (None, "z", day(day=1), "add")]
    table = spark.createDataFrame(events, "pattern string, category string, day date, action string")
    caps = [(1, "http://w.a.org/", day(day=1)), (2, "http://w.a.org/", day(day=2)), (3, "https://u@A.org:8/q", day(day=5)), (4, "http://a.org", day(day=20)), (5, "http://b.org/p/q", day(day=3)), (6, "http://b.org/x", day(day=3)), (7, "http://c.org/", day(day=3)), (8, None, day(day=3)), (9, "http://w.a.org/", None)]
    got = {r.page_id: r.blocked for r in url_filters.filtered(spark.createDataFrame(caps, "page_id long, url string, fetched_on date"), table).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False, 9: False}


def test_classifiers(spark, empty):
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        good, toxic = i % 2, i % 5 == 0
        body = [word() for _ in range(40)] if good else [word()] * 40
        rows.append((i, " ".join(body + (["nasty", "n4sty"] if toxic else [])), "en", "s", 1, "c", 1))
        labels.append((i, good, int(toxic)))
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = F.col("doc_id") % 3 != 1
    model = quality_gam.fitted(docs, table, train)
    assert all((r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in quality_gam.scored(docs, model).collect())
    assert np.allclose(quality_gam.Gam(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert all((r.score >= 0.7) == bool(labels[r.doc_id][2]) for r in toxicity.toxicity(docs, table, train).collect())
    assert toxicity.toxicity(empty, table.limit(0), train).count() == 0
    plain = toxicity.log_model(toxicity.word_trigrams(["idiot", "stupid"] * 50))
    assert toxicity.decode("1d10t", plain) == "idiot" and toxicity.decode("s t u p i d", plain) == "stupid"


def test_letters_set_apart():
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.word_trigrams(["idiot", "stupid"] * 50)))
    for text in ("s_t_u_p_i_d", "xx s__t__u__p__i__d.", "s t u p i d !", "s t u p 1 d", "$ t u p ! d", "s t_u-p.i d", "s  t u_p i  d", "5-t-u-p-1-d", "s t * p i d", "s*t*u*p*i*d", "s.t.u.u.u.p.i.d"):
        assert "stupid" in restorer.words(text), text
    for text in ("1 d 1 o t", "i_d_i_o_t", "an 1_d_1_0_t", "1 d 1 0 7"):
        assert "idiot" in restorer.words(text), text
    assert restorer.words("xs t u p") & {"stup", "xstup"} == set() and restorer.words("1 2 3 + 4") == set()


def test_long_spans():
    words = "you are a stupid idiot go away now please and do not come back here".split()
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.word_trigrams(words * 50)))
    spaced = " ".join("youareastupididiotgoaway")
    for text in (spaced, "_".join("youareastupididiotgoaway"), "y o u  a r e  a  s t u p i d  i d i o t  g o  a w a y", " ".join("youareastup1d1d10tgoaway"), " ".join([spaced] * 50)):
        assert {"stupid", "idiot"} <= restorer.words(text), text
    for text in ("st" + 60 * "u" + "pid", "st" + 3000 * "u" + "pid", 40 * "s" + 40 * "t" + 40 * "u" + "pid", "".join(c * 20 for c in "stupid"), "st" + 300 * "u" + "p1d", 60 * "path/" + "a_stup1d"):
        assert "stupid" in restorer.words(text), text
    long = "".join(random.Random(3).choices("0123456789abcdef", k=100_000))
    assert len(max(restorer.words(long + " a" + "123" * 30_000), key=len)) > 1000


def test_only_near_copies_count_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    apart = [(i, "one line that all texts share " + " ".join(word() for _ in range(40)), i % 2) for i in range(100)]
    base = " ".join(word() for _ in range(200))
    copies = [(200 + i, f"{base} {i}", int(i >= 10)) for i in range(20)] + [(300 + i, None, 0) for i in range(3)]
    joined = spark.createDataFrame(apart + copies, "doc_id long, text string, label int")
    assert sorted(toxicity._one_of_near_copies(joined)) == [*range(100), 200, 210, 300]


def test_decontaminate_without_ids(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    bad, good = " ".join(words[:60]), " ".join(words[70:])
    docs = spark.createDataFrame([(None, bad), (None, good), (None, None), (1, bad), (2, good), (2, bad), (3, good)], "doc_id long, text string")
    table = spark.createDataFrame([(None, " ".join(words[5:50])), (7, " ".join(words[10:20])), (8, None)], "item_id long, text string")
    for bound in (1_000_000, 0):
        got = decontaminate.contaminated(docs, table, broadcast_shingles=bound).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got), key=repr) == sorted(((d, *i) for d in (None, 1, 2) for i in ((None, 41, 41), (7, 6, 6))), key=repr)
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontaminate.stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, good), (None, None), (3, good)], key=repr)


def test_jaccard_stage(spark, docs, empty):
    """The stage against plain Python; the table has columns named as the operators' own."""
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    up = {k: k for k in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    loose = docs.where("doc_id < 3").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars", "digest", "rep")
    table = docs.unionByName(loose).unionByName(docs.where("doc_id = 0"))
    got = jaccard_join.stage(spark, table, "")
    assert got.columns == docs.columns
    want = [r for r in corpus() if up[r[0]] == r[0]]
    want += [r for r in want if r[0] == 0] + [(None, *r[1:]) for r in corpus()[:3]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard_join.stage(spark, empty, "").count() == 0


def test_suffix_dedup_stage(spark, empty):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared, whole = text(90), text(200)
    rows = [(1, text(40) + shared), (2, shared + text(30)), (3, whole), (4, whole), (5, text(20) + shared + text(20) + whole[20:100]), (6, ""), (None, whole)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "clash", 1) for k, t in rows], DOCS)
    seen, want = {}, []
    for k, t in rows[:-1]:
        cover = [False] * len(t)
        for p in range(len(t) - 49):
            if seen.setdefault(t[p : p + 50], k) < k:
                cover[p : p + 50] = [True] * 50
        kept = "".join(c for c, m in zip(t, cover) if not m)
        if kept or not any(cover):
            want.append((k, kept, "en", "s", len(kept), "clash", 1))
    want.append((None, whole, "en", "s", 200, "clash", 1))
    got = suffix_dedup.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.stage(spark, empty, "").count() == 0
