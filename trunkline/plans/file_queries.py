"""Queries over files: trunk files, plaintext logs, sidecars, appenders; and over the session and configuration."""

from __future__ import annotations

import io
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.operators import events as E
from trunkline.operators.browse import parse_viewer_command
from trunkline.operators.query import LogQuery, filter_query
from trunkline.operators.session import Cancelled, Session
from trunkline.plans import config as C
from trunkline.plans.queries import _BEFORE, _COUNTED, SHOWN, query
from trunkline.schema import LEVELS, VIRTUAL_TRUNK, events_as_log
from trunkline.sources import codec, plaintext, store, trunklog
from trunkline.sources import protobuf as P
from trunkline.sources.work import work_path

KB = 8
LINES = "\n\tat x\n\nend"
_LINES = "chr(10) || chr(9) || 'at x' || chr(10) || chr(10) || 'end'"
_MESSAGE = f"message || CASE WHEN level_id = 4 THEN {_LINES} ELSE '' END"
_TEXT = f"{SHOWN} || CASE WHEN level_id = 4 THEN {_LINES} ELSE '' END"
#: Greedy trunks by jumps over running totals of the lines' bytes; {rows} is what is packed, {limit} a trunk's bytes.
_PACKED = """(WITH RECURSIVE s AS (SELECT record_index, sum(9 + strlen(message)) OVER (ORDER BY record_index)::BIGINT AS total FROM {rows}),
 p AS (SELECT 0 AS trunk, 0::BIGINT AS base, greatest(min(total), max(CASE WHEN total <= {limit} THEN total END)) AS next FROM s
  UNION ALL SELECT g.trunk + 1, g.next, greatest(min(s.total), max(CASE WHEN s.total <= g.next + {limit} THEN s.total END)) FROM p g JOIN s ON s.total > g.next GROUP BY g.trunk, g.next)
 SELECT p.trunk AS trunk_index, s.record_index, p.next - p.base AS raw_bytes FROM p JOIN s ON s.total > p.base AND s.total <= p.next)"""
_TRUNKS = _PACKED.format(rows="lg", limit=KB * 1024)
_written: dict[tuple, str] = {}


def _write(spark: SparkSession, sf_dir: str, name: str = "gzip", trunk_kb: int = 64, parts: int = 4, keep: F.Column | None = None) -> str:
    """The log view, or its rows ``keep``, as a folder of trunk files, one for each part of a range sort."""
    trunklog.register(spark)
    path = work_path(spark, "log")
    log = events_as_log(spark, sf_dir)
    log = log if keep is None else log.where(keep)
    log = (log.repartitionByRange(parts, "record_index") if parts > 1 else log.repartition(1)).sortWithinPartitions("record_index")
    log.select("timestamp_millis", "level_id", "message").write.format("trunklog").mode("overwrite").option("compression", name).option("trunkSizeKb", trunk_kb).save(path)
    return path


def _once(spark: SparkSession, sf_dir: str, kind: str, make) -> str:
    """A file that several queries read, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    trunklog.register(spark)
    return spark.read.format("trunklog").load(_once(spark, sf_dir, "folder", lambda: _write(spark, sf_dir, trunk_kb=KB)))


def _one_file(spark: SparkSession, sf_dir: str) -> str:
    """The log as one trunk file without compression."""
    return store.listed(_once(spark, sf_dir, "one", lambda: _write(spark, sf_dir, "none", KB, parts=1)), ".tog")[0]


def _events(spark: SparkSession, sf_dir: str, lines: str = "") -> DataFrame:
    """The log view as events; those of errors have more lines, if asked for."""
    text = F.when(F.col("level_id") == 4, F.concat("message", F.lit(lines))).otherwise(F.col("message"))
    return events_as_log(spark, sf_dir).select(
        F.col("record_index").alias("sequence"), "timestamp_millis", "level", F.col("source").alias("logger"), F.col("context").alias("thread"), text.alias("message"), F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("variables")
    )


def _configured(*appenders: C.Appender, level: str = "TRACE") -> C.LogConfig:
    return C.LogConfig(level, tuple(a.name for a in appenders), {a.name: a for a in appenders})


def _plain_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as one plaintext file, with records of several lines."""

    def make():
        folder, appender = work_path(spark, "plain"), C.Appender("file", "file", pattern="%message", file_name="app.log", format="text")
        E.write_file(_events(spark, sf_dir, LINES), folder, _configured(appender), appender).collect()
        return store.join(folder, "app.log")

    return _once(spark, sf_dir, "plain", make)


def rows_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- reading trunk files

_RECORDS = "record_index, timestamp_millis, level_id::INT AS level_id, level, message"
FIELDS = ["record_index", "timestamp_millis", "level_id", "level", "message"]


@query("scan_full", f"SELECT {_RECORDS} FROM lg")
def scan_full(spark, sf_dir):
    """All records of a folder of files; their numbers run on from file to file."""
    return _folder(spark, sf_dir).select(*FIELDS)


@query("scan_query", f"SELECT {_RECORDS} FROM lg WHERE timestamp_millis <= (SELECT (min(timestamp_millis) + max(timestamp_millis)) // 2 FROM lg) AND level_id >= 2 AND contains(message, 'k')")
def scan_query(spark, sf_dir):
    """The upper time bound prunes files by their base time."""
    low, high = events_as_log(spark, sf_dir).agg(F.min("timestamp_millis"), F.max("timestamp_millis")).first()
    return filter_query(_folder(spark, sf_dir), LogQuery(end=(low + high) // 2, minimum_level="INFO", keyword="k")).select(*FIELDS)


@query("pushed_window", f"SELECT {_RECORDS} FROM lg WHERE record_index >= 480 AND record_index < 530")
def pushed_window(spark, sf_dir):
    """A window within a folder of files: other files and trunks are not read."""
    return _folder(spark, sf_dir).where("record_index >= 480 AND record_index < 530").select(*FIELDS)


@query("pushed_window_cut", "SELECT * FROM (SELECT timestamp_millis, level_id::INT AS level_id, message, row_number() OVER (PARTITION BY record_index % 4 ORDER BY record_index) - 1 AS record_index FROM lg) WHERE record_index >= 60 AND record_index < 180")
def pushed_window_cut(spark, sf_dir):
    """A window that cuts through trunks of four files: only some trunks are read, and parts of those at its ends."""
    parts = [_write(spark, sf_dir, trunk_kb=1, parts=1, keep=F.pmod("record_index", F.lit(4)) == k) for k in range(4)]
    rows = [spark.read.format("trunklog").load(path).where("record_index >= 60 AND record_index < 180") for path in parts]
    return reduce(DataFrame.unionByName, rows).select("timestamp_millis", "level_id", "message", "record_index")


@query("restore", f"SELECT record_index, {SHOWN} AS text FROM lg")
def restore(spark, sf_dir):
    return plaintext.restored(_folder(spark, sf_dir))


@query("read_header", f"SELECT '0.1.0' AS version, 'none' AS compression, {KB}::INT AS trunk_size_kb, min(timestamp_millis) AS base_timestamp_millis, count(*) AS total_records, (SELECT (max(trunk_index) + 1)::INT FROM {_TRUNKS}) AS trunk_count FROM lg")
def read_header(spark, sf_dir):
    _folder(spark, sf_dir)
    return spark.read.format("trunklog_header").load(_one_file(spark, sf_dir)).drop("file", "bytes")


@query("trunk_file_index", f"SELECT trunk_index::INT AS trunk_index, min(record_index) AS record_start_index, count(*)::INT AS line_count, raw_bytes AS compressed_length, 26 + 6 * (trunk_index + 1) + sum(raw_bytes) OVER (ORDER BY trunk_index) - raw_bytes AS start_offset FROM {_TRUNKS} GROUP BY trunk_index, raw_bytes")
def trunk_file_index(spark, sf_dir):
    """Headers of trunks only: without compression a trunk is as long as its records."""
    _folder(spark, sf_dir)
    return spark.read.format("trunklog_index").load(_one_file(spark, sf_dir)).drop("file")


@query("pack_trunks", f"SELECT trunk_index::INT AS trunk, count(*)::INT AS records, raw_bytes FROM {_TRUNKS} GROUP BY trunk_index, raw_bytes")
def pack_trunks(spark, sf_dir):
    """The greedy fill itself, over the lines in order; a fill is sequential, so a file is one task."""
    kb = KB

    def run(batches):
        lines = (codec.encode_line(0, 0, (m or "").encode()) for b in batches for m in b.column(0).to_pylist())
        for i, (n, raw) in enumerate(codec.pack_trunks(lines, kb)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([len(raw)], pa.int64())], names=["trunk", "records", "raw_bytes"])

    return events_as_log(spark, sf_dir).repartition(1).sortWithinPartitions("record_index").select("message").mapInArrow(run, "trunk int, records int, raw_bytes long")


@query("read_trunk", f"SELECT t.trunk_index::INT AS trunk_index, {', '.join('lg.' + f if f != 'level_id' else 'lg.level_id::INT AS level_id' for f in FIELDS)} FROM lg JOIN {_TRUNKS} t ON t.record_index = lg.record_index WHERE t.trunk_index = 2")
def read_trunk(spark, sf_dir):
    _folder(spark, sf_dir)
    return spark.read.format("trunklog").load(_one_file(spark, sf_dir)).where("trunk_index = 2").select("trunk_index", *FIELDS)


@query("scan_trunk_order", f"SELECT list_position([5, 2, 0], t.trunk_index)::INT AS pos, t.record_index FROM {_TRUNKS} t WHERE t.trunk_index IN (5, 2, 0)")
def scan_trunk_order(spark, sf_dir):
    """Trunks in an order given: each is read by its number, and says its place."""
    _folder(spark, sf_dir)
    order, file = [5, 2, 0], _one_file(spark, sf_dir)
    rows = [spark.read.format("trunklog").load(file).where(F.col("trunk_index") == t).select(F.lit(i + 1).alias("pos"), "record_index") for i, t in enumerate(order)]
    return reduce(DataFrame.unionByName, rows)


@query("parse_trunk", f"SELECT lg.timestamp_millis - (SELECT min(timestamp_millis) FROM lg) AS offset_millis, lg.level_id::INT AS level_id, lg.message FROM lg JOIN {_TRUNKS} t ON t.record_index = lg.record_index WHERE t.trunk_index = 1")
def parse_trunk(spark, sf_dir):
    """Payload bytes of one trunk, decoded."""
    _folder(spark, sf_dir)
    file = _one_file(spark, sf_dir)
    at = spark.read.format("trunklog_index").load(file).where("trunk_index = 1").select("start_offset", "compressed_length", "line_count")

    def run(batches):
        with store.reader(file) as f:
            for batch in batches:
                for offset, length, count in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(offset)
                    offsets, levels, texts = codec.decode_columns(f.read(length), count)
                    yield pa.RecordBatch.from_arrays([pa.array(offsets), pa.array(levels.astype("int32")), texts.cast(pa.string())], names=["offset_millis", "level_id", "message"])

    return at.mapInArrow(run, "offset_millis long, level_id int, message string")


@query("read_file_strict", "SELECT timestamp_millis, level_id::INT AS level_id, message FROM lg")
def read_file_strict(spark, sf_dir):
    """Whole files parsed from their bytes, every count checked."""
    _folder(spark, sf_dir)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = trunklog.scan_bytes(data)
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], k) for j, k in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["timestamp_millis", "level_id", "message"])

    path = _once(spark, sf_dir, "folder", lambda: _write(spark, sf_dir, trunk_kb=KB))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tog").load(path).select("content").mapInArrow(run, "timestamp_millis long, level_id int, message string")


# ---- writing trunk files


def _write_query(name: str):
    def run(spark, sf_dir):
        return spark.read.format("trunklog").option("mode", "strict").load(_write(spark, sf_dir, name)).select(*FIELDS)

    return run


for _codec in codec.CODECS:
    query(f"codec_{_codec}", f"SELECT {_RECORDS} FROM lg")(_write_query(_codec))
query("write_trunks", f"SELECT {_RECORDS} FROM lg")(_write_query("gzip"))


@query("write_single_file", f"SELECT {_RECORDS}, 1 AS files FROM lg")
def write_single_file(spark, sf_dir):
    """Four tasks' trunks behind one header."""
    trunklog.register(spark)
    path, log = work_path(spark, "single") + ".tog", events_as_log(spark, sf_dir)
    base = log.agg(F.min("timestamp_millis")).first()[0] or 0
    ordered = log.repartitionByRange(4, "record_index").sortWithinPartitions("record_index").select("timestamp_millis", "level_id", "message")
    ordered.write.format("trunklog").mode("overwrite").option("singleFile", "true").option("baseMillis", base).save(path)
    return spark.read.format("trunklog").option("mode", "strict").load(path).select(*FIELDS, F.lit(1).alias("files"))


@query("write_header", " UNION ALL ".join(f"SELECT '{name}' AS codec, {i + 1}::INT AS trunk_kb, {1000 * i}::BIGINT AS base, {i * i}::BIGINT AS records, {i}::INT AS trunks, 26 AS bytes" for i, name in enumerate(codec.CODECS)), base=False)
def write_header(spark, sf_dir):
    out = []
    for i, name in enumerate(codec.CODECS):
        data = codec.write_header(name, i + 1, 1000 * i, i * i, i)
        h = codec.read_header(data)
        out.append((h["codec"], h["trunk_kb"], h["base"], h["records"], h["trunks"], len(data)))
    return rows_of(spark, out, "codec string, trunk_kb int, base long, records long, trunks int, bytes int")


@query("codec_lookup", " UNION ALL ".join(f"SELECT {i}::INT AS id, '{name}' AS name" for i, name in enumerate(codec.CODECS)) + " UNION ALL SELECT -1, 'error' UNION ALL SELECT 8, 'error'", base=False)
def codec_lookup(spark, sf_dir):
    def name(i):
        try:
            return codec.codec_by_name(codec.codec_by_id(i).upper())
        except ValueError:
            return "error"

    return rows_of(spark, [(i, name(i)) for i in range(-1, 9)], "id int, name string")


def _grown(spark: SparkSession, sf_dir: str, finish: bool) -> DataFrame:
    """The log's first 512 records, appended one by one to a file that stays open."""
    trunklog.register(spark)
    path = work_path(spark, "grown") + ".tog"
    first = events_as_log(spark, sf_dir).where(f"record_index < {VIRTUAL_TRUNK}").select("record_index", "timestamp_millis", "level_id", "message")
    file = trunklog.TrunkFile(path, "zstd", 4)
    for r in sorted(first.collect()):
        file.append(r.timestamp_millis, r.level_id, r.message)
    if finish:
        file.flush()
    return spark.read.format("trunklog").load(path)


_FEW = f"(SELECT * FROM lg WHERE record_index < {VIRTUAL_TRUNK})"
_GROWN = f"SELECT record_index, trunk_index = max(trunk_index) OVER () AND raw_bytes < 4096 AS buffered FROM {_PACKED.format(rows=_FEW, limit=4096)}"
query("write_sidecar", _GROWN)(lambda spark, sf_dir: _grown(spark, sf_dir, False).select("record_index", "buffered"))
query("flush_trunk", f"SELECT count(*) AS records, 0::BIGINT AS buffered FROM {_FEW}")(lambda spark, sf_dir: _grown(spark, sf_dir, True).agg(F.count("*").alias("records"), F.count_if("buffered").alias("buffered")))
query("scan_sidecar", f"SELECT g.record_index, lg.timestamp_millis, lg.message FROM ({_GROWN}) g JOIN lg ON lg.record_index = g.record_index WHERE g.buffered")(lambda spark, sf_dir: _grown(spark, sf_dir, False).where("buffered").select("record_index", "timestamp_millis", "message"))


# ---- plaintext logs

_STARTS = f"(SELECT record_index, timestamp_millis, sum(strlen({_TEXT}) + 1) OVER (ORDER BY record_index)::BIGINT - strlen({_TEXT}) - 1 AS start, sum(strlen({_TEXT}) + 1) OVER ()::BIGINT AS size FROM lg)"
_RANGES = f"""(WITH RECURSIVE s AS {_STARTS}, r AS (SELECT 0 AS i, 0::BIGINT AS b UNION ALL SELECT r.i + 1, min(s.start) FROM r JOIN s ON s.start >= r.b + {KB * 1024} GROUP BY r.i, r.b)
 SELECT i, b AS begin, coalesce(lead(b) OVER (ORDER BY i), (SELECT max(size) FROM s)) AS stop FROM r)"""


@query("scan_plaintext", f"SELECT timestamp_millis, level_id::INT AS level_id, level, {_MESSAGE} AS message FROM lg")
def scan_plaintext(spark, sf_dir):
    """One file read in many byte ranges, records of several lines whole."""
    trunklog.register(spark)
    return spark.read.format("plainlog").option("rangeBytes", 5000).load(_plain_log(spark, sf_dir)).select("timestamp_millis", "level_id", "level", "message")


@query("find_record_start", f"SELECT i * 997 AS at, (SELECT min(start) FROM {_STARTS} WHERE start >= i * 997) AS start FROM range(0, 60) t(i)")
def find_record_start(spark, sf_dir):
    path = _plain_log(spark, sf_dir)
    size = store.size(path)
    with store.reader(path) as f:
        rows = [(i * 997, plaintext.find_record_start(f, i * 997, size)) for i in range(60)]
    return rows_of(spark, rows, "at long, start long")


def _planned(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[int, int, int]]]:
    path = _plain_log(spark, sf_dir)
    size = store.size(path)
    with store.reader(path) as f:
        return path, [(i, a, b) for i, (a, b) in enumerate(plaintext.plan_byte_ranges(f, 0, size, size, KB))]


@query("plan_byte_ranges", f"SELECT i::INT AS trunk, begin, stop FROM {_RANGES}")
def plan_byte_ranges(spark, sf_dir):
    """Within a task's range the plan is a chain of jumps."""
    return rows_of(spark, _planned(spark, sf_dir)[1], "trunk int, begin long, stop long")


@query("compress_range", f"SELECT r.i::INT AS trunk, count(*) AS records, min(s.timestamp_millis) AS first_ts, max(s.timestamp_millis) AS last_ts FROM {_RANGES} r JOIN {_STARTS} s ON s.start >= r.begin AND s.start < r.stop GROUP BY r.i")
def compress_range(spark, sf_dir):
    path, ranges = _planned(spark, sf_dir)
    base = plaintext.first_stamp(path)

    def run(batches):
        with store.reader(path) as f:
            for batch in batches:
                for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(a)
                    packer = codec.TrunkPacker("gzip", 65_535, base)
                    trunk, first, last = plaintext.compress_range(f.read(b - a), packer)
                    n, length = codec.TRUNK.unpack_from(trunk, 0)
                    lines = codec.decode_columns(codec.decompress(trunk[codec.TRUNK.size : codec.TRUNK.size + length], "gzip"), n)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([v], pa.int64()) for v in (len(lines), first, last))], names=["trunk", "records", "first_ts", "last_ts"])

    return rows_of(spark, ranges, "trunk int, begin long, stop long").mapInArrow(run, "trunk int, records long, first_ts long, last_ts long")


_CONVERTED = f"SELECT record_index, timestamp_millis, level_id::INT AS level_id, level, {_MESSAGE} AS message FROM lg"


@query("convert", _CONVERTED)
def convert(spark, sf_dir):
    """Plain text to one trunk file, read back."""
    trunklog.register(spark)
    target = work_path(spark, "converted") + ".tog"
    plaintext.convert(spark, _plain_log(spark, sf_dir), target, "zstd", KB)
    return spark.read.format("trunklog").option("mode", "strict").load(target).select(*FIELDS)


@query("merge_batches", _CONVERTED)
def merge_batches(spark, sf_dir):
    """Many tasks' ranges in one file: the record numbers say that they stand in order."""
    trunklog.register(spark)
    target = work_path(spark, "merged") + ".tog"
    plaintext.convert(spark, _plain_log(spark, sf_dir), target, "gzip", KB, step=3 * KB * 1024)
    return spark.read.format("trunklog").option("mode", "strict").load(target).select(*FIELDS)


@query("convert_to_folder", _CONVERTED)
def convert_to_folder(spark, sf_dir):
    """The same without putting the ranges together: one file each, read as one log."""
    trunklog.register(spark)
    target = work_path(spark, "ranges")
    plaintext.convert(spark, _plain_log(spark, sf_dir), target, "snappy", KB, step=3 * KB * 1024)
    return spark.read.format("trunklog").option("mode", "strict").load(target).select(*FIELDS)


@query("worker_count", "SELECT i::INT AS trunks, greatest(1, least(8, i))::INT AS workers FROM range(0, 20) t(i)", base=False)
def worker_count(spark, sf_dir):
    return rows_of(spark, [(n, plaintext.worker_count(8, n)) for n in range(20)], "trunks int, workers int")


# ---- loggers and appenders

_CALLS = [("TRACE", "a"), ("DEBUG", "b"), ("INFO", "c"), ("WARN", "d"), ("ERROR", "e")]


@query("logger_api", " UNION ALL ".join(f"SELECT {i}::BIGINT AS sequence, {1000 + i}::BIGINT AS timestamp_millis, '{level}' AS level, 'app' AS logger, '{text}' AS message" for i, (level, text) in enumerate(_CALLS)), base=False)
def logger_api(spark, sf_dir):
    log = E.EventLog(clock=iter(range(1000, 2000)).__next__)
    for level, text in _CALLS:
        getattr(log.logger("app"), level.lower())(text)
    return log.events(spark).select("sequence", "timestamp_millis", "level", "logger", "message")


@query("context_snapshot", "SELECT 0::BIGINT AS sequence, 'id=1' AS vars UNION ALL SELECT 1, 'id=2,user=u' UNION ALL SELECT 2, 'user=u' UNION ALL SELECT 3, ''", base=False)
def context_snapshot(spark, sf_dir):
    """An event keeps the variables of its moment, whatever is done to the context later."""
    log = E.EventLog(clock=iter(range(9)).__next__)
    for change in (lambda c: c.put("id", "1"), lambda c: (c.put("id", "2"), c.put("user", "u")), lambda c: c.put("id", None), lambda c: c.clear()):
        change(log.context)
        log.logger("app").info("x")
    return log.events(spark).select("sequence", F.array_join(F.transform(F.array_sort(F.map_entries("variables")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("vars"))


_BY_LEVEL = C.Appender("file", "file", pattern="%message", file_name="app.log", format="text", split_by_level=True)


@query("write_text", f"SELECT 'app-' || lower(level) || '.log' AS file, {SHOWN} AS line FROM lg WHERE level_id >= 1")
def write_text(spark, sf_dir):
    """Text files by level, read back."""
    folder = work_path(spark, "text")
    E.write_file(_events(spark, sf_dir), folder, _configured(_BY_LEVEL, level="DEBUG"), _BY_LEVEL).collect()
    return spark.read.text(folder).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("line"))


@query("write_tog_appender", "SELECT 'app-' || lower(level) || '.log' AS file, count(*)::INT AS trunks, count(*) AS records FROM lg GROUP BY level")
def write_tog_appender(spark, sf_dir):
    """Trunk files by level; as every event is flushed, each has a trunk of its own."""
    trunklog.register(spark)
    folder, appender = work_path(spark, "tog"), C.Appender("file", "file", pattern="%message", file_name="app.log", format="tog", compression="zstd", trunk_size_kb=64, split_by_level=True)
    files = E.write_file(_events(spark, sf_dir), folder, _configured(appender), appender).collect()
    heads = [spark.read.format("trunklog_header").load(store.join(folder, r.path)) for r in files] or [spark.read.format("trunklog_header").load(folder)]
    return reduce(DataFrame.unionByName, heads).select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), F.col("trunk_count").alias("trunks"), F.col("total_records").alias("records"))


@query("rotate", f"SELECT target || CASE age WHEN 0 THEN '' ELSE '.' || age END AS path, age::INT AS archive, count(*) AS records, sum(strlen({SHOWN}) + 1)::BIGINT AS bytes FROM (SELECT *, max(segment) OVER (PARTITION BY target) - segment AS age FROM {_BEFORE.replace('strlen(message) + 1', f'strlen({SHOWN}) + 1')}) JOIN lg USING (record_index) WHERE age <= 2 GROUP BY target, age")
def rotate(spark, sf_dir):
    """Text files by level that rotate at 4 KB, with two archives."""
    appender = C.Appender("file", "file", pattern="%message", file_name="logs/app.log", format="text", split_by_level=True, max_file_size_bytes=4096, max_archived_files=2)
    return E.write_file(_events(spark, sf_dir), work_path(spark, "rotated"), _configured(appender), appender)


@query("write_console", f"SELECT (row_number() OVER (ORDER BY record_index) - 1)::BIGINT AS n, stamp || ' [' || level || '] events ' || context || ' ' || message AS line FROM {_FEW} WHERE level_id >= 3")
def write_console(spark, sf_dir):
    """Lines of the first 512 events, as they come to a console."""
    appender, out = C.Appender("out", "console", level="WARN", pattern="%logger %thread %message", target="SYSTEM_ERR"), io.StringIO()
    E.write_console(_events(spark, sf_dir).where(f"sequence < {VIRTUAL_TRUNK}"), _configured(appender), appender, out)
    return rows_of(spark, list(enumerate(out.getvalue().splitlines())), "n long, line string")


@query("file_logger", "SELECT i AS record_index, 1000 + i * 7 AS timestamp_millis, ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][(i % 5) + 1] AS level, 'm' || i AS message FROM range(0, 200) t(i)", base=False)
def file_logger(spark, sf_dir):
    trunklog.register(spark)
    path = work_path(spark, "logger") + ".tog"
    log = E.FileLogger(path, "gzip", 1, clock=iter(range(1000, 9000, 7)).__next__)
    for i in range(200):
        getattr(log.logger("app"), LEVELS[i % 5].lower())(f"m{i}")
    log.close()
    return spark.read.format("trunklog").option("mode", "strict").load(path).select("record_index", "timestamp_millis", "level", "message")


@query("noop_sink", "SELECT 0::BIGINT AS events", base=False)
def noop_sink(spark, sf_dir):
    E.write_nowhere(_events(spark, sf_dir))
    log = E.NoLogger()
    log.logger("app").error("gone", ValueError("x"))
    return spark.range(0).agg(F.count("*").alias("events"))


_PROPERTIES = """
app.root.level=info
app.appender.out.type=console
app.appender.out.target=system_err
app.appender.disk.type=file
app.appender.disk.fileName=logs/app.log
app.appender.disk.format=tog
app.appender.disk.compression=ZSTD
app.appender.disk.policies.size.size=2 MB
app.masking.contentRules=password
"""


@query("load_config", """SELECT 'out' AS name, 'console' AS type, 'TRACE' AS level, 'SYSTEM_ERR' AS target, NULL AS file_name, NULL AS format, NULL AS compression, 0::BIGINT AS max_file_size_bytes
  UNION ALL SELECT 'disk', 'file', 'TRACE', NULL, 'logs/app.log', 'tog', 'zstd', 2097152""", base=False)  # fmt: skip
def load_config(spark, sf_dir):
    return C.from_properties(_PROPERTIES, "app").appenders_table(spark).select("name", "type", "level", "target", "file_name", "format", "compression", "max_file_size_bytes")


@query("generate_large", """WITH n AS (SELECT i, (i::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM range(0, 2000) t(i)),
 b AS (SELECT i, (xor(a, a // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM n),
 c AS (SELECT i, (xor(a, a // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM b)
 SELECT i AS sequence, ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'][(i % 5) + 1] AS level, 'event=' || i || ' traceId=' || xor(a, a // 2147483648::UHUGEINT) || ' payload=' AS head, 768 AS payload,
 ' email=bulk' || i || '@example.com password=super-secret-' || i AS tail FROM c""", base=False)  # fmt: skip
def generate_large(spark, sf_dir):
    """Generated events; of the payload, the number of hexadecimal digits."""
    rows = E.generate_large(spark, 2000)
    part = lambda n: F.regexp_extract("message", r"^(event=\d+ traceId=\d+ payload=)([0-9a-f]*)( email=.*)$", n)
    return rows.select("sequence", "level", part(1).alias("head"), F.length(part(2)).alias("payload"), part(3).alias("tail"))


# ---- session

_VISIT = "CASE WHEN trunk_index = 7 THEN 0 WHEN trunk_index > 7 THEN 2 * (trunk_index - 7) - 1 ELSE 2 * (7 - trunk_index) END"


def _session(spark: SparkSession, sf_dir: str) -> Session:
    log = events_as_log(spark, sf_dir)
    trunks = (log.agg(F.max("trunk_index")).first()[0] or 0) + 1
    at = min(7, trunks - 1)
    return Session(log, trunks, at * VIRTUAL_TRUNK + 116, at)


@query("search_cancel", "SELECT 2::BIGINT AS scanned, false AS active, least(7, max(trunk_index)) * 512 + 116 AS record_index FROM lg")
def search_cancel(spark, sf_dir):
    """A search for what is nowhere, cancelled after the second trunk: the state is cleared and the place kept."""
    session, seen = _session(spark, sf_dir), []
    try:
        session.search("no such text", lambda p: seen.append(p) or len(seen) < 2)
    except Cancelled:
        pass
    return rows_of(spark, [(len(seen), session.active is not None, session.current)], "scanned long, active boolean, record_index long")


@query("clear_search", "SELECT true AS before, false AS after", base=False)
def clear_search(spark, sf_dir):
    session = _session(spark, sf_dir)
    session.search("purchase")
    before = session.active is not None
    session.clear_search()
    return rows_of(spark, [(before, session.active is not None)], "before boolean, after boolean")


_LAST = "least(7, (SELECT max(trunk_index) FROM lg))"
_OUT = _VISIT.replace("7", _LAST)


@query("level_filter_progress", f"""SELECT (row_number() OVER (ORDER BY visit))::BIGINT AS scanned, trunk_index + 1 AS position, total FROM (SELECT trunk_index, {_OUT} AS visit, count(*) OVER () AS total,
  sum(n) OVER (ORDER BY {_OUT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT lg.trunk_index, sum(CASE WHEN level_id = 2 THEN rows ELSE 0 END) AS n FROM lg JOIN ({_COUNTED}) c ON c.record_index = lg.record_index GROUP BY lg.trunk_index)) WHERE coalesce(before, 0) < 700""")
def level_filter_progress(spark, sf_dir):
    """Trunks scanned outward until the level's wrapped rows fill 700 rows."""
    done = _session(spark, sf_dir).filter_level("INFO", 40, 700)
    return rows_of(spark, [(p.scanned, p.position, p.total) for p in done], "scanned long, position int, total long")


@query("search_session", f"""SELECT * FROM (SELECT record_index, (row_number() OVER (ORDER BY record_index) - 1)::BIGINT AS step FROM lg WHERE record_index > {_LAST} * 512 + 116 AND contains({SHOWN}, 'purchase') ORDER BY record_index LIMIT 5)""")
def search_session(spark, sf_dir):
    """A search and four steps ahead."""
    session = _session(spark, sf_dir)
    session.search("purchase")
    steps = [session.current] + [session.step(ahead=True) for _ in range(4)]
    return rows_of(spark, [(r, i) for i, r in enumerate(steps)], "record_index long, step long")


_TYPED = {":help": "help:None", ":128": "jump:128", ":fatal": "level:ERROR", "/key word": "search:key word", ":0": "error", "+42": "error", "/": "error", ":verbose": "error"}


@query("parse_viewer_command", " UNION ALL ".join(f"SELECT '{k}' AS typed, '{v}' AS got" for k, v in _TYPED.items()), base=False)
def viewer_command(spark, sf_dir):
    def one(text):
        try:
            return ":".join(map(str, parse_viewer_command(text)))
        except ValueError:
            return "error"

    return rows_of(spark, [(k, one(k)) for k in _TYPED], "typed string, got string")


# ---- protobuf and codecs of single records


@query("proto_query", "SELECT 0 AS n, NULL::BIGINT AS start, NULL::BIGINT AS stop, NULL AS level, NULL AS keyword UNION ALL SELECT 1, 5, NULL, 'WARN', '' UNION ALL SELECT 2, NULL, 0, 'TRACE', 'k%_' UNION ALL SELECT 3, 0, 9007199254740993, 'ERROR', 'é'", base=False)
def proto_query(spark, sf_dir):
    asked = [LogQuery(), LogQuery(5, None, "WARN", ""), LogQuery(None, 0, "TRACE", "k%_"), LogQuery(0, 9007199254740993, "ERROR", "é")]
    got = [P.decode_query(P.encode_query(q)) for q in asked]
    return rows_of(spark, [(i, q.start, q.end, q.minimum_level, q.keyword) for i, q in enumerate(got)], "n int, start long, stop long, level string, keyword string")


@query("log_codec", "SELECT record_index, timestamp_millis, level_id::INT AS level_id, message FROM lg")
def log_codec(spark, sf_dir):
    """Records through the codec interface, one by one."""
    one = P.ProtobufCodec()

    def run(batches):
        for batch in batches:
            got = [(i, one.decode(one.encode((ts, level, "", "", text, {})))) for i, ts, level, text in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in got], pa.int64()), pa.array([r[0] for _, r in got], pa.int64()), pa.array([r[1] for _, r in got], pa.int32()), pa.array([r[4] for _, r in got], pa.string())],
                names=["record_index", "timestamp_millis", "level_id", "message"],
            )

    return events_as_log(spark, sf_dir).select("record_index", "timestamp_millis", "level_id", "message").mapInArrow(run, "record_index long, timestamp_millis long, level_id int, message string")
