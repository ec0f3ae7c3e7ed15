"""Trunk files that grow, folders as one log, pruning, sinks, and the session."""

import io
import random

import pytest

from trunkline.operators import events as E
from trunkline.operators.browse import bottom_page, resolve_top
from trunkline.operators.session import Cancelled, Session, outward, waves
from trunkline.plans.config import Appender, LogConfig
from trunkline.sources import codec as C
from trunkline.sources import trunklog
from trunkline.sources.trunklog import TrunkFile, TrunkReader, scan_bytes


def test_growing_file_and_crash(spark, tmp_path):
    trunklog.register(spark)
    path = str(tmp_path / "a.tog")
    rows = [(1000 + i, i % 5, "x" * 300 + str(i)) for i in range(20)]
    file = TrunkFile(path, "gzip", 1)
    for r in rows:
        file.append(*r)
    with pytest.raises(ValueError, match="back in time"):
        file.append(5, 0, "late")
    got = spark.read.format("trunklog").load(path).orderBy("record_index").collect()  # the file was never closed
    assert [(r.timestamp_millis, r.level_id, r.message) for r in got] == rows and sum(r.buffered for r in got) == 2
    file.file.write(b"\0\x05half a trunk")
    file.file.close()
    again = TrunkFile(path, recover=True)
    again.append(2000, 1, "after")
    again.close()
    assert scan_bytes((tmp_path / "a.tog").read_bytes()) == [*rows, (2000, 1, "after")]
    assert (tmp_path / "a.tog.buffer").stat().st_size == 0
    with TrunkFile(path):
        pass
    assert scan_bytes((tmp_path / "a.tog").read_bytes()) == []


def test_columns_equal_lines():
    rng = random.Random(4)
    for _ in range(30):
        rows = [(i, rng.randrange(5), "é" * rng.randrange(40)) for i in range(rng.randrange(30))]
        payload = b"".join(C.encode_line(o, v, t.encode()) for o, v, t in rows)
        offsets, levels, texts = C.decode_columns(payload, len(rows))
        assert list(zip(offsets.tolist(), levels.tolist(), texts.to_pylist())) == rows
        assert len(C.decode_columns(payload[:-1], partial=True)[0]) == max(0, len(rows) - 1)
    for bad, why in ((C.LINE.pack(0, 9, 0), "level"), (C.encode_line(0, 1, b"\xff"), "UTF8"), (C.encode_line(0, 1, b"x")[:-1], "truncated")):
        with pytest.raises(Exception, match=why):
            C.decode_columns(bad)
    with pytest.raises(ValueError, match="trailing"):
        C.decode_columns(C.encode_line(0, 1, b"x") + b"zz", 1)
    assert C.crc32c(b"123456789") == 0xE3069283
    data = rng.randbytes(30_001)
    assert C.crc32c(data, lanes=8) == C.crc32c(data, lanes=1 << 20)


def test_folder_is_one_log_and_is_pruned(spark, tmp_path, monkeypatch):
    trunklog.register(spark)
    for k in range(5):
        (tmp_path / f"{k}.tog").write_bytes(C.encode_file([(1000 * k + i, i % 5, f"{k}/{i}" + "x" * 200) for i in range(40)], "zstd", 1))
    read = lambda: spark.read.format("trunklog").load(str(tmp_path))
    assert [r.record_index for r in read().orderBy("timestamp_millis").collect()] == list(range(200))
    assert sorted(r.message[:4].strip("x") for r in read().where("record_index between 78 and 81").collect()) == ["1/38", "1/39", "2/0", "2/1"]

    def parts(**bounds):
        reader = TrunkReader({"path": str(tmp_path)})
        for name, (low, high) in bounds.items():
            reader.bounds[name] = [low, high]
        return reader.partitions()

    count = lambda found: sum(len(p.trunks) for p in found)
    every = count(parts())
    assert every == 50 and count(parts(record_index=(78, 81))) == 2 and count(parts(timestamp_millis=(0, 1999))) == 20
    assert [p.first_record for p in parts(record_index=(10**9, None))] == [-1]
    monkeypatch.setattr(trunklog, "WALKED_FILES", 2)
    reader = TrunkReader({"path": str(tmp_path)})
    reader.bounds["record_index"] = [78, 81]
    late = reader.partitions()
    assert [p.trunks for p in late] == [None, None] and sum(b.num_rows for p in late for b in reader.read(p)) == 8


def test_single_file_needs_order(spark, tmp_path):
    trunklog.register(spark)
    rows = spark.createDataFrame([(i, 2, f"m{i}") for i in range(100)], "timestamp_millis long, level_id int, message string")
    target = str(tmp_path / "one.tog")
    write = lambda df: df.write.format("trunklog").mode("overwrite").option("singleFile", "true").option("baseMillis", 0).save(target)
    write(rows.repartitionByRange(3, "timestamp_millis").sortWithinPartitions("timestamp_millis"))
    assert [r.message for r in spark.read.format("trunklog").option("mode", "strict").load(target).orderBy("record_index").collect()] == [f"m{i}" for i in range(100)]
    with pytest.raises(Exception, match="back in time"):
        write(rows.repartitionByRange(3, rows.timestamp_millis.desc()).sortWithinPartitions("timestamp_millis"))


def test_appenders(spark, tmp_path):
    trunklog.register(spark)
    log = E.EventLog("main", iter(range(1_777_672_860_253, 1_777_672_999_999)).__next__)
    log.context.put("requestId", "REQ-123456")
    for _ in range(12):
        log.logger("app").info("password=secret phone=13812345678")
    log.logger("app").debug("dropped")
    log.logger("app").error("boom", ValueError("why"))
    assert log.logger("app") is log.logger("app")
    out = Appender("out", "console", pattern="%message id=%var{requestId} user=%var{userId:-guest}", target="SYSTEM_OUT")
    text = Appender("text", "file", pattern="%message", file_name="logs/level-%level.log", file_pattern="logs/archive/level-%level-%i.log", format="text", split_by_level=True, max_file_size_bytes=200, max_archived_files=2)
    tog = Appender("tog", "file", pattern="%message", file_name="logs/all.tog", format="tog", compression="none", trunk_size_kb=64)
    config = LogConfig("INFO", ("out", "text", "tog"), {a.name: a for a in (out, text, tog)}, ("password", "mobile"), {"requestId": "partial"})
    stream = io.StringIO()
    written = E.write_events(log.events(spark), str(tmp_path), config, {"out": stream})
    lines = stream.getvalue().splitlines()
    assert written["out"] == 13 and lines[0] == "2026-05-01 22:01:00,253 [INFO] password=****** phone=138****5678 id=RE****56 user=guest"
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert names == ["logs/all.tog", "logs/archive/level-info-1.log", "logs/archive/level-info-2.log", "logs/level-error.log", "logs/level-info.log"]
    assert all(len((tmp_path / n).read_bytes()) <= 200 for n in names if "info" in n)
    got = scan_bytes((tmp_path / "logs/all.tog").read_bytes())
    assert written["tog"] == 13 == len(got) and got[-1][2].startswith("boom\n") and C.read_header((tmp_path / "logs/all.tog").read_bytes())["trunks"] == 13
    with pytest.raises(ValueError):
        log.context.put(None, "x")


def test_trunk_files_rotate_after_they_pass_the_limit(spark, tmp_path):
    log = E.EventLog(clock=iter(range(1000, 2000)).__next__)
    for i in range(20):
        log.logger("x").info("y" * 50 + f"{i:02d}")
    appender = Appender("f", "file", pattern="%message", file_name="a.tog", format="tog", compression="none", trunk_size_kb=64, max_file_size_bytes=200, max_archived_files=9)
    files = {r.path: (r.archive, r.records, r.bytes) for r in E.write_file(log.events(spark), str(tmp_path), LogConfig("INFO", ("f",), {"f": appender}), appender).collect()}
    each = 6 + 9 + 52  # a trunk of one record; a file begins with 26 bytes, and rotates once it holds more than 200
    assert files == {"a.tog": (0, 2, 26 + 2 * each)} | {f"a.tog.{i}": (i, 3, 26 + 3 * each) for i in range(1, 7)}
    assert [r[2][-2:] for r in scan_bytes((tmp_path / "a.tog.1").read_bytes())] == ["15", "16", "17"]


def records_in(spark, trunks):
    rows, n = [], 0
    for t, messages in enumerate(trunks):
        for m in messages:
            rows.append((n, t, 1000 + n, "INFO", 2, m))
            n += 1
    return spark.createDataFrame(rows, "record_index long, trunk_index int, timestamp_millis long, level string, level_id int, message string")


def test_session_goldens(spark):
    assert list(outward(2, 5)) == [2, 3, 1, 4, 0] and [len(w) for w in waves(iter(range(40)))] == [8, 16, 16]
    s = Session(records_in(spark, [["backward-hit"], ["center-a", "center-b"], ["forward-hit"]]), 3, 1, 1)
    seen = []
    assert s.search(" hit ", lambda p: seen.append((p.scanned, p.total, p.position))) == 1 and s.current == 3
    assert seen == [(1, 3, 2), (2, 3, 3)] and s.step(ahead=False) == 0 and s.step(ahead=True) == 3 and s.step(ahead=True) == 0
    one = Session(records_in(spark, [["before-hit", "focus-line", "after-hit"]]), 1, 1, 0)
    assert one.search("hit") == 2 and one.current == 2 and one.active.ordered == [0, 2] and one.step(False) == 0 and one.step(True) == 2
    hits = [["x"] for _ in range(130)]
    hits[0] = hits[119] = hits[121] = ["hit"]
    far = Session(records_in(spark, hits), 130, 120, 120)
    assert far.search("hit") == 1 and far.current == 121
    with pytest.raises(ValueError, match="not found"):
        far.search("nothing like it")
    with pytest.raises(Cancelled):
        far.search("nothing", lambda p: p.scanned < 121 and p.percent < 60)
    assert far.active is None and far.current == 121


def test_viewport(spark):
    rows = records_in(spark, [["short", "long " * 30, "short", "short", "long " * 60, "end"]])
    assert resolve_top(rows, 0, 0, 40, 10, 10) == 0 and resolve_top(rows, 5, 2, 40, 10, 10) == 2
    assert resolve_top(rows, 0, 5, 1000, 10, 3) == 3
    assert resolve_top(rows, 0, 5, 40, 6, 10) == 5 and resolve_top(rows, 0, 5, 40, 11, 10) == 3
    assert [r.record_index for r in bottom_page(rows, 40, 5, 10).collect()] == [5]
