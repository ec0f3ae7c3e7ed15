"""Plaintext logs: byte ranges aligned to record starts, records from them, trunks from them, and text from records.

A record starts at a line shaped like a time stamp; other lines join the record before. A large log is cut into
byte ranges; each range's task moves both ends to the next record start by itself, so no pass over the
file comes first, and a record is read by exactly one task, however many lines it has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from trunkline.functions.text import display_text, is_record_start, parse_level, parse_timestamp, split_lines
from trunkline.schema import LEVEL_ALIASES, LEVELS
from trunkline.sources import store
from trunkline.sources.codec import DEFAULT_TRUNK_KB, TrunkPacker, codec_by_name

STAMP_BYTES = 23
START_BYTES = STAMP_BYTES + 1
#: What stands between the digits of a time stamp, by position (fixed values).
MARKS = {4: "-", 7: "-", 10: " ", 13: ":", 16: ":", 19: ",", 23: " "}
DIGITS = np.array([i for i in range(STAMP_BYTES) if i not in MARKS])
FIRST_SCAN, SCAN_BYTES = 4096, 1 << 20
RANGE_BYTES = 64 << 20
LEAST_RANGE = 8 << 20
MOST_RANGES = 20_000
LF, CR = 10, 13


# ---------------------------------------------------------------- by line, as columns


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of whole files; for logs that fit in a row. ``plainlog`` reads larger ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return files.select("file", F.posexplode(split_lines(F.col("value"))).alias("line_no", "line"))


def assemble(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(file, record_index, timestamp_millis, level, message) from (file, line_no, line).

    White lines within a record become empty; blank lines before the first record are left out, and other
    lines there are an error (left out too if not strict). For lines that are rows already: a file is
    numbered by one window. Files are read by ``plainlog``, range by range.
    """
    start = is_record_start(F.col("line"))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = lines.withColumn("n", F.sum(start.cast("int")).over(order))
    blank = F.col("line").rlike(r"^\s*$")
    if strict:
        tagged = tagged.withColumn("n", F.when((F.col("n") == 0) & ~blank, F.raise_error(F.lit("text before the first record")).cast("long")).otherwise(F.col("n")))
    body = F.when(blank, F.lit("")).otherwise(F.col("line"))
    grouped = tagged.where("n > 0").groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("line_no", body.alias("line")))).alias("rows"))
    head = F.col("rows")[0]["line"]
    level, first = parse_level(F.substr(head, F.lit(25)))
    rest = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), lambda r: r["line"])
    message = F.when(F.size("rows") > 1, F.concat(first, F.lit("\n"), F.array_join(rest, "\n"))).otherwise(first)
    return grouped.select("file", (F.col("n") - 1).cast("long").alias("record_index"), parse_timestamp(head, strict).alias("timestamp_millis"), level.alias("level"), message.alias("message"))


def restored(records: DataFrame) -> DataFrame:
    """Records as text: time stamp, level, first line, and further lines as they are."""
    return records.select("record_index", display_text(F.col("timestamp_millis"), F.col("level"), F.col("message")).alias("text"))


# ---------------------------------------------------------------- by byte range, as arrays


def record_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which of the lines that begin at ``begin`` are shaped like the start of a record."""
    out = begin + START_BYTES <= len(data)
    at = begin[out]
    good = np.ones(len(at), dtype=bool)
    for i, mark in MARKS.items():
        good &= data[at + i] == ord(mark)
    at = at[good]
    digits = data[at[:, None] + DIGITS] - np.uint8(48)
    good[good] = (digits < 10).all(axis=1)
    out[out] = good
    return out


def find_record_start(file, offset: int, size: int) -> int | None:
    """The first record start at or after ``offset``; an offset within a line is not at a line's start."""
    at = offset
    if offset:
        file.seek(offset - 1)
        if file.read(1) != b"\n":
            at = None
    where, held, ask = offset, b"", min(FIRST_SCAN, SCAN_BYTES)  # held: from the last line start that may still become a record's
    while where < size:
        file.seek(where)
        piece = file.read(min(ask, size - where))
        ask = min(2 * ask, SCAN_BYTES)
        if not piece:
            return None
        block = np.frombuffer(held + piece, np.uint8)
        origin = where - len(held)
        breaks = np.flatnonzero(block == LF) + 1
        begin = np.concatenate([[at - origin], breaks]) if at is not None else breaks
        found = begin[record_starts(block, begin)] if len(begin) else begin
        if len(found):
            return origin + int(found[0])
        where += len(piece)
        if len(breaks):
            at = origin + int(breaks[-1])
        held = b"" if at is None else (held + piece)[at - origin :][: START_BYTES - 1]
        if at is not None and len(held) + at < where:  # the line goes on beyond a start's length: it is none
            at, held = None, b""
    return None


def plan_byte_ranges(file, begin: int, end: int, size: int, trunk_kb: int) -> Iterator[tuple[int, int]]:
    """Ranges of about a trunk's source bytes between two record starts: each jumps ahead and moves to the next start."""
    while begin < end:
        target = begin + trunk_kb * 1024
        stop = end if target >= end else min(find_record_start(file, target, size) or size, end)
        yield begin, stop
        begin = stop


def _stamps(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """UTC milliseconds of the stamps at ``at``; an impossible date or time is an error."""
    digits = (data[at[:, None] + DIGITS] - np.uint8(48)).astype(np.int32)
    number = lambda lo, hi: digits[:, lo:hi] @ (10 ** np.arange(hi - lo - 1, -1, -1)).astype(np.int32)
    date, hour, minute, second, milli = number(0, 8), number(8, 10), number(10, 12), number(12, 14), number(14, 17)
    fresh = np.ones(len(date), dtype=bool)
    fresh[1:] = date[1:] != date[:-1]
    days, ok = _days(date[fresh])
    run = np.cumsum(fresh) - 1
    ok = ok[run] & (hour < 24) & (minute < 60) & (second < 60)
    if not ok.all():
        where = int(at[~ok][0])
        raise ValueError(f"no such time: {data[where : where + STAMP_BYTES].tobytes().decode('utf-8', 'replace')}")
    return days[run] * 86_400_000 + ((hour * 60 + minute) * 60 + second).astype(np.int64) * 1000 + milli


def _days(date: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970, whether there is such a date) of numbers YYYYMMDD."""
    year, month, day = date // 10_000, date // 100 % 100, date % 100
    first = (np.maximum(year, 1) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (np.clip(month, 1, 12) - 1)
    days = first.astype("datetime64[D]") + (day - 1)
    return days.astype(np.int64), (year >= 1) & (month >= 1) & (month <= 12) & (days.astype("datetime64[M]") == first)


def _token_level(token: bytes) -> int:
    """Level id of what stands in brackets, or -1."""
    word = token.decode("utf-8", "replace").strip(" ").upper()
    word = LEVEL_ALIASES.get(word, word)
    return LEVELS.index(word) if word in LEVELS else -1


def _levels(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level id, where the message begins) of contents [begin, end): a level in brackets and one space go, else INFO and all."""
    level, message = np.full(len(begin), LEVELS.index("INFO"), np.int64), begin.copy()
    open_ = np.flatnonzero((begin < end) & (data[np.minimum(begin, len(data) - 1)] == ord("[")))
    closing = np.flatnonzero(data == ord("]"))
    if not len(open_) or not len(closing):
        return level, message
    close = closing[np.minimum(np.searchsorted(closing, begin[open_]), len(closing) - 1)]
    inside = (close > begin[open_]) & (close < end[open_])
    open_, close = open_[inside], close[inside]
    width = close - begin[open_] - 1
    known: dict[bytes, int] = {}
    got = np.full(len(open_), -1, np.int64)
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        if w == 0:
            continue
        tokens = np.ascontiguousarray(data[(begin[open_[same]] + 1)[:, None] + np.arange(w)])
        rows, back = np.unique(tokens.view(f"V{w}").ravel(), return_inverse=True)
        for token in {r.tobytes() for r in rows} - known.keys():
            known[token] = _token_level(token)
        got[same] = np.array([known[r.tobytes()] for r in rows])[back]
    open_, close, got = open_[got >= 0], close[got >= 0], got[got >= 0]
    level[open_] = got
    after = close + 1
    message[open_] = after + ((after < end[open_]) & (data[np.minimum(after, len(data) - 1)] == 32))
    return level, message


def parse_range(source: bytes, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(millis, level ids, bounds, message bytes) of a range that begins at a record start.

    Line ends lose a CR, white lines become empty, and a record's last line end goes. ``first``: the range
    begins the file, where blank lines may come before the first record and other lines are an error.
    """
    source.decode("utf-8")  # an error, if it is not
    data = np.frombuffer(source, np.uint8)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(1, np.int64), data
    breaks = np.flatnonzero(data == LF)
    begin = np.concatenate([[0], breaks + 1])
    end = np.concatenate([breaks, [len(data)]])
    if begin[-1] == len(data):
        begin, end = begin[:-1], end[:-1]
    stop = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == CR) & (end < len(data)))
    blank = _blank(data, begin, stop)
    heads = record_starts(data, begin)
    record = np.cumsum(heads) - 1
    if (record < 0).any():
        if not first or (~blank[record < 0]).any():
            raise ValueError("text before the first record")
        begin, end, stop, blank, heads, record = (x[record >= 0] for x in (begin, end, stop, blank, heads, record))
    if not len(record):
        return none, none, np.zeros(1, np.int64), data[:0]
    at = begin[heads]
    millis = _stamps(data, at)
    level, message = _levels(data, at + START_BYTES, stop[heads])
    lead = begin.copy()
    lead[heads] = message
    stop = np.where(~blank | heads, np.maximum(stop, lead), lead)
    more = np.zeros(len(record), np.int64)  # a line end stays before another line of the record
    more[:-1] = record[1:] == record[:-1]
    keep = np.zeros(len(data) + 1, dtype=np.int8)  # no index comes twice in one of these sums
    keep[lead] += 1
    keep[stop] -= 1
    keep[end[more > 0]] += 1
    keep[end[more > 0] + 1] -= 1
    sizes = np.add.reduceat(stop - lead + more, np.flatnonzero(heads))
    return millis, level, np.concatenate([[0], np.cumsum(sizes)]), data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]


def _blank(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which lines [begin, stop) have white space only."""
    out = stop == begin
    white = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    some = np.flatnonzero(~out)
    some = some[white(data[begin[some]])]
    for i in some[white(data[stop[some] - 1])].tolist():  # white at both ends
        out[i] = not data[begin[i] : stop[i]].tobytes().strip(b" \t\n\v\f\r")
    return out


def compress_range(source: bytes, packer: TrunkPacker, first: bool = False) -> tuple[bytes, int | None, int | None]:
    """(trunks, first time, last time) of one planned range: a trunk of its own, or several if it has too many records."""
    millis, level, bounds, text = parse_range(source, first)
    if not len(millis):
        return b"", None, None
    return packer.add(millis, level, bounds, text) + packer.rest(), int(millis[0]), int(millis[-1])


def aligned(file, begin: int, end: int, size: int) -> tuple[int, int]:
    """A raw byte range with both ends moved to record starts; the file's first range keeps what comes before."""
    start = 0 if begin == 0 else find_record_start(file, begin, size)
    stop = size if end >= size else find_record_start(file, end, size)
    if begin == 0 and stop is None and size:
        return 0, size
    return (size if start is None else start), (size if stop is None else stop)


def range_bytes(size: int, least: int = RANGE_BYTES) -> int:
    """Bytes of a task's range: never more than ``MOST_RANGES`` ranges a file."""
    return max(least, -(-size // MOST_RANGES))


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int
    size: int


class PlainReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self):
        found = store.listed(self.path)
        out = []
        for file in [self.path] if found is None else found:
            size = store.size(file)
            step = range_bytes(size, self.step)
            out += [ByteRange(file, at, min(at + step, size), size) for at in range(0, size, step)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        with store.reader(partition.file) as f:
            begin, end = aligned(f, partition.begin, partition.end, partition.size)
            first = partition.begin == 0
            for lo, hi in plan_byte_ranges(f, begin, end, partition.size, 1024):
                f.seek(lo)
                millis, level, bounds, text = parse_range(f.read(hi - lo), first)
                first = False
                n = len(millis)
                texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.string())
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([partition.file])).dictionary_decode()
                levels = pa.DictionaryArray.from_arrays(pa.array(level.astype(np.int32)), pa.array(LEVELS)).dictionary_decode()
                yield pa.RecordBatch.from_arrays(
                    [name, pa.array(np.full(n, lo)), pa.array(np.arange(n)), pa.array(millis), levels, pa.array(level.astype(np.int32)), texts],
                    names=["file", "range_start", "position", "timestamp_millis", "level", "level_id", "message"],
                )


class PlainLog(DataSource):
    """Records of plaintext logs: a file or a folder of files. (file, range_start, position) is their order; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "plainlog"

    def schema(self) -> str:
        return "file string, range_start long, position long, timestamp_millis long, level string, level_id int, message string"

    def reader(self, schema: StructType) -> PlainReader:
        return PlainReader(dict(self.options))


# ---------------------------------------------------------------- conversion


def worker_count(cores: int, trunks: int) -> int:
    return max(1, min(cores, trunks))


def worker_batches(trunks: int, workers: int) -> list[range]:
    """Contiguous groups of equal length; the first ones get one more where it doesn't come out even."""
    if not trunks:
        return []
    workers = min(max(1, workers), trunks)
    each, more = divmod(trunks, workers)
    ends = [0]
    for i in range(workers):
        ends.append(ends[-1] + each + (i < more))
    return [range(a, b) for a, b in zip(ends, ends[1:])]


def first_stamp(path: str) -> int | None:
    """Time of the first record; None for a log without records."""
    size = store.size(path)
    if not size:
        return None
    with store.reader(path) as f:
        at = find_record_start(f, 0, size)
        if at is None:
            f.seek(0)
            parse_range(f.read(size), first=True)
            return None
        f.seek(at)
        return int(_stamps(np.frombuffer(f.read(STAMP_BYTES), np.uint8), np.zeros(1, np.int64))[0])


PARTS = "part long, file string, records long, trunks long, first_ts long, last_ts long, source_bytes long, bytes long"


def convert(spark: SparkSession, source: str, target: str, codec: str = "gzip", trunk_kb: int = DEFAULT_TRUNK_KB, step: int | None = None) -> dict:
    """One plaintext log to one trunk file (``target`` ends in .tog), or to a folder with a file for each range.

    A task takes a byte range, plans trunks within it, and writes them; the driver gets one row a
    range (``MOST_RANGES`` at most), checks the order of time across ranges, and for a single
    file puts the parts together behind a header. All offsets count from the log's first record.
    """
    from trunkline.sources.codec import write_header
    from trunkline.sources.trunklog import PENDING, merge_parts

    codec = codec_by_name(codec)
    size, base = store.size(source), first_stamp(source)
    single = target.endswith(".tog")
    folder = f"{target}-parts-{uuid.uuid4().hex[:8]}" if single else target
    if step is None:  # some ranges a core, so that all end at about one time
        step = min(RANGE_BYTES, max(LEAST_RANGE, size // (4 * spark.sparkContext.defaultParallelism)))
    step = range_bytes(size, step)
    ranges = [(i, at, min(at + step, size)) for i, at in enumerate(range(0, size, step))] if base is not None else []

    def run(batches):
        for batch in batches:
            for part, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                packer, out, records, written = TrunkPacker(codec, trunk_kb, base), [], None, 0
                first_ts = last_ts = None
                with store.reader(source) as f:
                    lo, hi = aligned(f, begin, end, size)
                    for a, b in plan_byte_ranges(f, lo, hi, size, trunk_kb):
                        f.seek(a)
                        trunks, one, two = compress_range(f.read(b - a), packer, a == 0)
                        out.append(trunks)
                        first_ts, last_ts = one if first_ts is None else first_ts, two if two is not None else last_ts
                name = ""
                if packer.records:
                    name = store.join(folder, f"part-{part:05d}-{uuid.uuid4().hex[:8]}.tog")
                    with store.writer(name + PENDING) as g:
                        g.write(b"" if single else write_header(codec, trunk_kb, base, packer.records, packer.trunks))
                        for x in out:
                            g.write(x)
                            written += len(x)
                row = [part, name, packer.records, packer.trunks, first_ts, last_ts, max(0, hi - lo), written]
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in PARTS.split(", ")])

    rows = []
    if ranges:
        cut = spark.createDataFrame(ranges, "part long, begin long, end long").repartitionByRange(len(ranges), "part")
        rows = sorted(cut.mapInArrow(run, PARTS).collect())
    done = [r for r in rows if r.records]
    if single:
        merge_parts(target, [(r.file + PENDING, r.records, r.trunks, r.first_ts, r.last_ts) for r in done], codec, trunk_kb, base or 0)
        if done:
            store.remove_folder(folder)
    else:
        for x, y in zip(done, done[1:]):
            if y.first_ts < x.last_ts:
                raise ValueError(f"records must not go back in time: after {x.file}")
        for r in done:
            store.rename(r.file + PENDING, r.file)
    return {"records": sum(r.records for r in done), "trunks": sum(r.trunks for r in done), "source_bytes": size, "output_bytes": sum(r.bytes for r in done), "workers": worker_count(spark.sparkContext.defaultParallelism, len(ranges)), "ranges": len(ranges)}
