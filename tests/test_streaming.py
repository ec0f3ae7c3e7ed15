import os

from trunkline.sources import trunklog
from trunkline.sources.codec import HEADER, encode_file
from trunkline.streaming.append import append_batch, append_stream
from trunkline.streaming.tail import START, new_trunks

OLD = [(1000 + i, i % 5, "x" * 300 + str(i)) for i in range(20)]
NEW = OLD + [(2000 + i, 3, f"later {i}") for i in range(50)]


def drain(stream, spark, checkpoint, table):
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted(r.message for r in spark.read.parquet(table).collect())


def test_tail_reads_new_trunks_once(spark, tmp_path):
    trunklog.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.tog").write_bytes(encode_file(OLD, "none", 1))
    tail = lambda: spark.readStream.format("trunklog").load(str(logs)).select("record_index", "message")
    where = (str(tmp_path / "cp"), str(tmp_path / "out"))
    assert drain(tail(), spark, *where) == sorted(m for _, _, m in OLD)
    first = encode_file(OLD, "none", 1)
    grown = encode_file(NEW, "none", 1)
    whole = len(new_trunks(str(logs / "a.tog"), START)[1])
    assert grown[HEADER.size : HEADER.size + 600] == first[HEADER.size : HEADER.size + 600] and whole > 1
    (logs / "b.tog").write_bytes(encode_file(NEW[20:], "zstd", 1))
    assert drain(tail(), spark, *where) == sorted(m for _, _, m in NEW)
    assert drain(tail(), spark, *where) == sorted(m for _, _, m in NEW)


def test_tail_leaves_an_unfinished_trunk(tmp_path):
    data = encode_file(OLD, "none", 1)
    file = tmp_path / "a.tog"
    file.write_bytes(data)
    every = new_trunks(str(file), START)[1]
    file.write_bytes(data[:-5])
    assert new_trunks(str(file), START)[1] == every[:-1]
    trunk, at, record, count, length = every[-2]
    file.write_bytes(data)
    assert new_trunks(str(file), [trunk + 1, at + length, record + count])[1] == every[-1:]
    file.write_bytes(b"")
    assert new_trunks(str(file), START) == (None, [])


def test_append_rejects_late_rows_and_repeats_safely(spark, tmp_path):
    path, late = str(tmp_path / "logs"), str(tmp_path / "late")
    make = lambda rows: spark.createDataFrame(rows, "timestamp_millis long, level_id int, message string")
    append_batch(make([(30, 2, "c"), (10, 2, "a"), (20, 3, "b")]), 0, path, late)
    second = make([(30, 2, "same"), (29, 2, "late"), (None, 2, "no time"), (40, 4, "d")])
    for _ in range(2):
        append_batch(second, 1, path, late)
    append_batch(make([]), 2, path, late)
    got = [(r.timestamp_millis, r.message) for r in spark.read.format("trunklog").load(path).collect()]
    assert sorted(got) == [(10, "a"), (20, "b"), (30, "c"), (30, "same"), (40, "d")]
    assert sorted(r.message for r in spark.read.parquet(late).collect()) == ["late", "no time"]


def test_append_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("id AS timestamp_millis", "2 AS level_id", "concat('m', id) AS message").write.parquet(source)
    rows = spark.readStream.schema("timestamp_millis long, level_id int, message string").parquet(source)
    query = append_stream(rows, str(tmp_path / "logs"), str(tmp_path / "late"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.read.format("trunklog").load(str(tmp_path / "logs")).count() == 100
    assert os.listdir(tmp_path / "logs" / "_marks") == ["000000000000_99"]
