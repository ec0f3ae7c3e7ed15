"""Plaintext parsing by byte range against line-by-line Python."""

import datetime
import io
import random
import re

import numpy as np
import pytest

from trunkline.sources import plaintext as P
from trunkline.sources import store, trunklog
from trunkline.sources.codec import TrunkPacker

START = re.compile(rb"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} ")


def by_line(source):
    lines = source.split(b"\n")
    if lines and lines[-1] == b"":
        lines.pop()
    out = []
    for i, line in enumerate(lines):
        if (i < len(lines) - 1 or source.endswith(b"\n")) and line.endswith(b"\r"):
            line = line[:-1]
        if START.match(line):
            content, level = line[24:], 2
            m = re.match(rb"\[([^\]]*)\]", content)
            if m and P._token_level(m[1]) >= 0:
                level, content = P._token_level(m[1]), content[m.end() :]
                content = content[1:] if content[:1] == b" " else content
            moment = datetime.datetime.strptime(line[:23].decode(), "%Y-%m-%d %H:%M:%S,%f").replace(tzinfo=datetime.UTC)
            out.append([round(moment.timestamp() * 1000), level, content])
        elif out:
            out[-1][2] += b"\n" + (b"" if not line.strip(b" \t\r\x0b\x0c") else line)
        elif line.strip():
            raise ValueError("text before the first record")
    return [tuple(r) for r in out]


def a_log(rng, n):
    out = [b"", b"  "] if rng.random() < 0.5 else []
    t = 1_777_672_860_253
    for _ in range(n):
        t += rng.randrange(100)
        stamp = datetime.datetime.fromtimestamp(t / 1000, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S,") + f"{t % 1000:03d} "
        level = rng.choice(["[INFO] ", "[warn] x", "[ ERROR ]", "[FATAL] ", "[GID:] ", "[]", "no", "", "[unclosed ", "[DEBUG]"])
        out.append((stamp + level + rng.choice(["", "abc", "é]" * 5, "x" * 200])).encode())
        out += [rng.choice([b"", b"  ", b"\tat x", b"2026-05-01 22:01:00,25", b"2026-05-01 22:01:00,253", b"x2026-05-01 22:01:00,253 ", b"[ERROR]"]) for _ in range(rng.choice([0, 0, 0, 1, 3]))]
    end = rng.choice([b"\n", b"\r\n"])
    return end.join(out) + rng.choice([b"", end, end + end])


def rows(got):
    millis, levels, at, text = got
    return [(m, v, text[a:b].tobytes()) for m, v, a, b in zip(millis.tolist(), levels.tolist(), at, at[1:])]


def test_ranges_equal_lines(monkeypatch):
    rng = random.Random(2)
    for _ in range(150):
        monkeypatch.setattr(P, "SCAN_BYTES", rng.choice([5, 30, 64, 1000]))
        source = a_log(rng, rng.randrange(1, 12))
        file, size = io.BytesIO(source), len(source)
        want = by_line(source)
        assert rows(P.parse_range(source, True)) == want
        starts = [i for i in range(size) if (i == 0 or source[i - 1] == 10) and START.match(source, i)]
        for offset in range(0, size, 7):
            assert P.find_record_start(file, offset, size) == next((s for s in starts if s >= offset), None)
        for step in (7, 50, 300):
            got = []
            for at in range(0, size, step):
                lo, hi = P.aligned(file, at, min(at + step, size), size)
                if lo < hi:
                    file.seek(lo)
                    got += rows(P.parse_range(file.read(hi - lo), at == 0))
            assert got == want


def test_errors_of_plain_logs():
    good = b"2026-05-01 22:01:00,253 [INFO] a\n"
    for bad, why in ((b"garbage\n" + good, "before the first"), (b"2026-02-30 22:01:00,253 a\n", "no such time"), (b"2026-05-01 25:01:00,253 a\n", "no such time"), (good + b"\xff\n", "utf-8")):
        with pytest.raises(ValueError, match=why):
            P.parse_range(bad, True)
    with pytest.raises(ValueError, match="back in time"):
        P.compress_range(good + good.replace(b",253", b",252"), TrunkPacker("none", 64), True)
    assert rows(P.parse_range(b"", True)) == [] and rows(P.parse_range(b"\n \n", True)) == []
    assert rows(P.parse_range(b"2024-02-29 00:00:00,000 x", True)) == [(1709164800000, 2, b"x")]


def test_plan_jumps_by_trunks():
    record = b"2026-05-01 22:01:00,253 [ERROR] failed\n" + b"\tat x.y.Z\n" * 120
    source = record + b"2026-05-01 22:01:00,278 [INFO] recovered\n"
    ranges = list(P.plan_byte_ranges(io.BytesIO(source), 0, len(source), len(source), 1))
    assert ranges == [(0, len(record)), (len(record), len(source))] and len(record) > 1024
    assert [list(b) for b in P.worker_batches(5, 2)] == [[0, 1, 2], [3, 4]] and P.worker_batches(0, 3) == [] and P.worker_count(8, 0) == 1


@pytest.mark.parametrize("step", [2000, 1 << 20])
def test_convert(spark, tmp_path, step):
    trunklog.register(spark)
    rng = random.Random(step)
    source = a_log(rng, 400)
    (tmp_path / "app.log").write_bytes(source)
    want = [(i, m, v, t.decode()) for i, (m, v, t) in enumerate(by_line(source))]
    for target in (f"{tmp_path}/one.tog", f"file://{tmp_path}/many"):
        done = P.convert(spark, f"{tmp_path}/app.log", target, "zstd", 2, step=step)
        assert done["records"] == 400 and done["trunks"] >= len(source) // 4096
        got = spark.read.format("trunklog").option("mode", "strict").load(target).select("record_index", "timestamp_millis", "level_id", "message")
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["app.log", "many", "one.tog"]
    got = spark.read.format("plainlog").option("rangeBytes", step).load(f"{tmp_path}/app.log").orderBy("range_start", "position")
    assert [(r.timestamp_millis, r.level_id, r.message) for r in got.collect()] == [w[1:] for w in want]


def test_convert_checks_time_across_ranges(spark, tmp_path):
    trunklog.register(spark)
    line = "2026-05-01 22:01:0{},253 [INFO] " + "x" * 500 + "\n"
    (tmp_path / "a.log").write_text("".join(line.format(i) for i in (1, 2, 0)))
    with pytest.raises(Exception, match="back in time|out of range"):
        P.convert(spark, str(tmp_path / "a.log"), str(tmp_path / "a.tog"), step=600)
    (tmp_path / "b.log").write_text("\n")
    assert P.convert(spark, str(tmp_path / "b.log"), str(tmp_path / "b.tog"))["records"] == 0
    assert spark.read.format("trunklog").load(str(tmp_path / "b.tog")).count() == 0


def test_stores_by_uri(tmp_path, monkeypatch):
    """The same calls through a path and through another store's interface."""
    from pyarrow import fs

    monkeypatch.setattr(store, "_remote", lambda uri: (fs.LocalFileSystem(), str(tmp_path) + uri.removeprefix("mem://x")))
    for base in (str(tmp_path / "p"), "mem://x/q"):
        assert store.listed(base) is None and store.size(store.join(base, "a")) == 0
        for name in ("b.tog", "a.tog", "c.txt"):
            with store.writer(store.join(base, name)) as f:
                f.write(name.encode())
        assert [x.rsplit("/", 1)[1] for x in store.listed(base, ".tog")] == ["a.tog", "b.tog"]
        store.rename(store.join(base, "c.txt"), store.join(base, "d.tog"))
        assert store.size(store.join(base, "d.tog")) == 5 and len(store.listed(base, ".tog", "d")) == 1
        with store.writer(store.join(base, "e")) as f:
            store.append_to(f, store.join(base, "a.tog"))
            store.append_to(f, store.join(base, "b.tog"))
        with store.reader(store.join(base, "e")) as f:
            assert f.read() == b"a.togb.tog"
        store.remove(store.join(base, "e"))
        store.remove(store.join(base, "e"))
        assert store.size(store.join(base, "e")) == 0
        store.remove_folder(base)
        assert store.listed(base) is None


def test_writer_to_a_store_without_seeking(tmp_path, monkeypatch):
    """Files of another store get their header by a second pass."""
    import pyarrow as pa
    from pyarrow import fs

    import pyspark

    monkeypatch.setattr(store, "_remote", lambda uri: (fs.LocalFileSystem(), str(tmp_path) + uri.removeprefix("mem://x")))
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(np.full(50, 2)), pa.array([f"m{i}" for i in range(50)])], names=["timestamp_millis", "level_id", "message"])
    writer = trunklog.TrunkWriter({"path": "mem://x/logs", "trunkSizeKb": "1", "compression": "none"}, True)
    writer.commit([writer.write(iter([batch.slice(0, 7), batch.slice(7)]))])
    reader = trunklog.TrunkReader({"path": "mem://x/logs", "mode": "strict"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.column(6).to_pylist()]
    assert got == [f"m{i}" for i in range(50)]
