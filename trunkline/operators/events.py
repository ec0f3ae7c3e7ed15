"""Log events: level-named entry points, a context of variables, and sinks that write events by configuration.

Events are rows (sequence, timestamp_millis, level, logger, thread, message, variables). A sink takes what
passes the root's and its own level, renders it, and writes it: text and trunk files are split by level
and rotated by size as configured, one task a file; consoles get their lines in order.
"""

from __future__ import annotations

import sys
import time
import traceback
from collections.abc import Callable, Iterable
from types import MappingProxyType
from typing import TextIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.functions import masking as M
from trunkline.functions import text as T
from trunkline.operators.rotation import retained, rotated
from trunkline.plans.config import Appender, LogConfig
from trunkline.schema import LEVELS
from trunkline.sources import store
from trunkline.sources.codec import DEFAULT_TRUNK_KB, HEADER, TRUNK, TrunkPacker, compress, encode_line, text_column, write_header
from trunkline.sources.trunklog import PENDING, TrunkFile

EVENTS = "sequence long, timestamp_millis long, level string, logger string, thread string, message string, variables map<string,string>"


def now_millis() -> int:
    return time.time_ns() // 1_000_000


def with_trace(message: str, error: BaseException | None) -> str:
    if error is None:
        return message
    return (message + "\n" + "".join(traceback.format_exception(error))).rstrip("\r\n")


class Context:
    """Variables that go with every event; an event takes a copy that doesn't change later."""

    def __init__(self) -> None:
        self._values: dict[str, str] = {}

    def put(self, key: str, value: str | None) -> None:
        if key is None:
            raise ValueError("a context key may not be null")
        if value is None:
            self._values.pop(key, None)
        else:
            self._values[key] = value

    def remove(self, key: str | None) -> None:
        self._values.pop(key, None)

    def clear(self) -> None:
        self._values.clear()

    def snapshot(self) -> MappingProxyType:
        return MappingProxyType(dict(self._values))


class Logger:
    """Entry points named by level; what becomes of an event is up to ``take``."""

    def __init__(self, name: str, take: Callable[[str, str, str], None]) -> None:
        self.name, self._take = name, take

    def trace(self, message: str) -> None:
        self._take(self.name, "TRACE", message)

    def debug(self, message: str) -> None:
        self._take(self.name, "DEBUG", message)

    def info(self, message: str) -> None:
        self._take(self.name, "INFO", message)

    def warn(self, message: str) -> None:
        self._take(self.name, "WARN", message)

    def error(self, message: str, error: BaseException | None = None) -> None:
        self._take(self.name, "ERROR", with_trace(message, error))


class Loggers:
    """One logger a name."""

    def __init__(self) -> None:
        self._known: dict[str, Logger] = {}
        self.closed = False

    def logger(self, name: str) -> Logger:
        if self.closed:
            raise ValueError("the loggers are closed")
        if name is None:
            raise ValueError("a logger needs a name")
        return self._known.setdefault(name, Logger(name, self.take))

    def take(self, name: str, level: str, message: str) -> None:
        raise NotImplementedError


class EventLog(Loggers):
    """Gathers events on the driver, to be written as rows."""

    def __init__(self, thread: str = "main", clock: Callable[[], int] = now_millis) -> None:
        super().__init__()
        self.context, self.thread, self.clock, self.rows = Context(), thread, clock, []

    def take(self, name: str, level: str, message: str) -> None:
        self.rows.append((len(self.rows), self.clock(), level, name, self.thread, message, dict(self.context.snapshot())))

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, EVENTS)


class FileLogger(Loggers):
    """Straight to a trunk file, without patterns or masking."""

    def __init__(self, path: str, codec: str = "gzip", trunk_kb: int = DEFAULT_TRUNK_KB, clock: Callable[[], int] = now_millis) -> None:
        super().__init__()
        self.file, self.clock = TrunkFile(path, codec, trunk_kb), clock

    def take(self, name: str, level: str, message: str) -> None:
        if self.closed:
            raise ValueError("the loggers are closed")
        self.file.append(self.clock(), LEVELS.index(level), message)

    def close(self) -> None:
        self.closed = True
        self.file.close()


class NoLogger(Loggers):
    """Drops every event."""

    def take(self, name: str, level: str, message: str) -> None:
        pass


def write_nowhere(events: DataFrame) -> None:
    events.write.format("noop").mode("overwrite").save()


# ---------------------------------------------------------------- sinks


def passing(events: DataFrame, config: LogConfig, appender: Appender) -> DataFrame:
    need = max(LEVELS.index(config.level), LEVELS.index(appender.level))
    return events.where(T.level_to_id(F.col("level")) >= need)


def body(config: LogConfig, appender: Appender, environ: dict | None = None) -> Column:
    return M.render_pattern(appender.pattern, F.col("message"), F.col("logger"), F.col("thread"), F.col("variables"), list(config.content_rules), config.variable_rules, environ)


def line(config: LogConfig, appender: Appender, environ: dict | None = None) -> Column:
    return T.display_text(F.col("timestamp_millis"), F.col("level"), body(config, appender, environ))


def write_console(events: DataFrame, config: LogConfig, appender: Appender, stream: TextIO | None = None, environ: dict | None = None) -> int:
    """Print the events' lines in order, a partition at a time; returns how many."""
    stream = stream or (sys.stderr if appender.target == "SYSTEM_ERR" else sys.stdout)
    n = 0
    for row in passing(events, config, appender).orderBy("timestamp_millis", "sequence").select(line(config, appender, environ).alias("line")).toLocalIterator(prefetchPartitions=True):
        print(row.line, file=stream)
        n += 1
    return n


def _trunk_bytes(frame: DataFrame, codec: str) -> DataFrame:
    """``frame`` (..., level_id, body) with ``size``: the bytes of a trunk of that record alone; its offset, 4 fixed bytes, is taken as 0."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            sizes = [TRUNK.size + len(compress(encode_line(0, level, (text or "").encode()), codec)) for level, text in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "size"])

    return frame.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", size long")


def write_file(events: DataFrame, folder: str, config: LogConfig, appender: Appender, environ: dict | None = None) -> DataFrame:
    """Write a file appender's files below ``folder``: (path, archive, records, bytes) of each, the active one with archive 0.

    Text files hold a line for each event; trunk files a trunk for each, as every event is flushed. Rotation is
    decided first, over (target, size) alone; archives beyond the configured number are never
    written. Then each file is one task, which streams it.
    """
    text = appender.format != "tog"
    codec, kb = appender.compression or "gzip", appender.trunk_size_kb or DEFAULT_TRUNK_KB
    target = M.split_by_level_path(appender.file_name, F.col("level")) if appender.split_by_level else F.lit(appender.file_name)
    rows = passing(events, config, appender).select(
        target.alias("target"), "sequence", "timestamp_millis", T.level_to_id(F.col("level")).alias("level_id"), (line if text else body)(config, appender, environ).alias("body")
    )
    sized = rows.withColumn("size", (F.octet_length("body") + 1).cast("long")) if text else _trunk_bytes(rows, codec)
    segments = rotated(sized.select("target", "sequence", "size"), "target", "size", "sequence", appender.max_file_size_bytes, after=not text, begin=0 if text else HEADER.size)
    kept = retained(segments, "target", appender.max_archived_files).select("target", "sequence", F.coalesce("archive", F.lit(0)).cast("int").alias("archive"))
    pattern = M.split_by_level_path(appender.file_pattern, F.col("level_name")) if appender.file_pattern and appender.split_by_level else F.lit(appender.file_pattern or "")
    placed = rows.join(kept, ["target", "sequence"]).withColumn("level_name", T.id_to_level(F.col("level_id")))
    name = F.when(F.col("archive") == 0, F.col("target")).otherwise(M.archive_name(F.when(pattern != "", pattern).otherwise(F.concat("target", F.lit(".%i"))), F.col("archive")))
    placed = placed.select(name.alias("path"), "archive", "sequence", "timestamp_millis", "level_id", "body").repartition("path").sortWithinPartitions("path", "timestamp_millis", "sequence")

    def run(batches):
        path = out = None
        archive = records = size = 0
        packer = None

        def done():
            out.close()
            if not text:  # the header counts the trunks
                with store.writer(whole := store.join(folder, path)) as f:
                    f.write(write_header(codec, kb, packer.base, packer.records, packer.trunks))
                    store.append_to(f, whole + PENDING)
                store.remove(whole + PENDING)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([archive], pa.int32()), pa.array([records]), pa.array([size])], names=["path", "archive", "records", "bytes"])

        for batch in batches:
            paths, archives = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1]], len(paths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if paths[lo] != path:
                    if out is not None:
                        yield done()
                    path, archive, records, packer = paths[lo], archives[lo], 0, TrunkPacker(codec, kb)
                    size = 0 if text else HEADER.size
                    out = store.writer(store.join(folder, path) + ("" if text else PENDING))
                part = batch.slice(lo, hi - lo)
                if text:
                    pieces = [("\n".join(part.column(5).to_pylist()) + "\n").encode()]
                else:
                    millis, levels = (part.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (3, 4))
                    at, data = text_column(part.column(5))
                    pieces = [packer.add(millis[i : i + 1], levels[i : i + 1], at[i : i + 2], data) + packer.rest() for i in range(hi - lo)]
                for piece in pieces:
                    out.write(piece)
                    size += len(piece)
                records += hi - lo
        if out is not None:
            yield done()

    return placed.mapInArrow(run, "path string, archive int, records long, bytes long")


def write_events(events: DataFrame, folder: str, config: LogConfig, streams: dict[str, TextIO] | None = None, environ: dict | None = None) -> dict[str, int]:
    """Send events to all appenders that the root names; records written by each."""
    out = {}
    for name in config.root:
        appender = config.appenders[name]
        if appender.type == "console":
            out[name] = write_console(events, config, appender, (streams or {}).get(name), environ)
        else:
            out[name] = sum(r.records for r in write_file(events, folder, config, appender, environ).collect())  # one row a file
    return out


# ---------------------------------------------------------------- generated logs

PAYLOAD_CHARS = 768


def _mix(x: np.ndarray) -> np.ndarray:
    """A step of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _payloads(seed: np.ndarray) -> list[str]:
    """Hexadecimal digits of a chain of values, each mixed from the one before and the digits so far."""
    parts: list[list[str]] = [[] for _ in seed]
    value, length = seed.copy(), np.zeros(len(seed), np.int64)
    todo = np.arange(len(seed))
    while len(todo):
        value[todo] = _mix(value[todo] + length[todo].astype(np.uint64))
        for i, v in zip(todo.tolist(), value[todo].tolist()):
            parts[i].append(f"{v:x}")
        length[todo] += np.array([len(parts[i][-1]) for i in todo.tolist()])
        todo = todo[length[todo] < PAYLOAD_CHARS]
    return ["".join(p)[:PAYLOAD_CHARS] for p in parts]


def generate_large(spark: SparkSession, rows: int, start_millis: int = 0, logger: str = "large") -> DataFrame:
    """``rows`` events of rotating levels with a traceable id, a long payload and personal data to mask; a millisecond apart."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            index = batch.column(0).to_numpy(zero_copy_only=False)
            trace = _mix(index.astype(np.uint64))
            message = [f"event={i} traceId={t} payload={p} email=bulk{i}@example.com password=super-secret-{i}" for i, t, p in zip(index.tolist(), trace.tolist(), _payloads(trace))]
            variables = [[("requestId", f"REQ-{i}"), ("userId", f"user-{t}")] for i, t in zip(index.tolist(), trace.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(index), pa.array(index + start_millis), pa.array([LEVELS[i % len(LEVELS)] for i in index.tolist()]), pa.array([logger] * len(index)), pa.array(["main"] * len(index)),
                    pa.array(message), pa.array(variables, pa.map_(pa.string(), pa.string())),
                ],
                names=[x.split()[0] for x in EVENTS.split(", ")],
            )

    return spark.range(rows).mapInArrow(run, EVENTS)
