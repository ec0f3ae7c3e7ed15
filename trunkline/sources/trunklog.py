"""Spark data source ``trunklog``: reading with pruning, and writing.

Options: ``path`` (a file, or a folder whose .tog files, in order of their names, are one log), ``mode`` permissive |
index | strict, ``includeBuffer`` (the sidecar's records after the trunks, default true), and for writing
``compression``, ``trunkSizeKb``, ``prefix`` (of the file names; overwriting replaces only files with it, so a
repeated write of one batch leaves one copy), ``singleFile`` (with ``baseMillis``: all tasks' trunks behind one
header at ``path``), ``baseMillis`` (offsets count from it instead of from each file's first record).

Planning reads 26 bytes a file. record_index runs on from file to file by the headers' counts. Bounds on
record_index prune files, then trunks; bounds on trunk_index prune trunks; an upper bound on timestamp_millis
prunes files by their base time; Spark evaluates every filter again. Up to ``WALKED_FILES`` files are
split by their trunk headers while planning, more are walked by one task each. Paths may be URIs of any store.

Writing makes one file a task, so output scales with tasks; sort and partition the rows before. Files are streamed
under a name that readers don't see, and renamed when the job commits; on overwriting, old files go after that.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trunkline.schema import LEVELS, MAX_TRUNK_RECORDS, RECORD_SCHEMA
from trunkline.sources import store
from trunkline.sources.codec import DEFAULT_TRUNK_KB, HEADER, TRUNK, TrunkPacker, codec_by_name, decode_columns, decode_lines, decompress, read_header, scan_index, text_column, write_header

TRUNKS_PER_TASK = 16
WALKED_FILES = 64
PENDING = ".pending"


def local(path: str) -> str:
    found = store.local_path(path)
    return path if found is None else found


def log_files(path: str) -> list[str]:
    found = store.listed(path, ".tog")
    return [path] if found is None else found


def file_header(file: str) -> tuple[int, dict | None]:
    """(bytes, header); an absent or empty file has no header."""
    size = store.size(file)
    if not size:
        return 0, None
    with store.reader(file) as f:
        return size, read_header(f.read(HEADER.size))


def file_index(file: str, size: int, header: dict, mode: str) -> list[tuple[int, int, int, int]]:
    """The file's trunks, by their headers alone; checked against the file's header as ``mode`` asks."""
    with store.reader(file) as f:
        index = scan_index(f, size, header)
    total = sum(t[2] for t in index)
    if mode != "permissive" and total != header["records"]:
        raise ValueError(f"{file}: the header counts {header['records']} records, the trunks {total}")
    if mode == "strict" and (index[-1][0] + index[-1][3] if index else HEADER.size) != size:
        raise ValueError(f"{file}: trailing bytes")
    return index


@dataclass
class Trunks(InputPartition):
    file: str
    base: int
    codec: str
    trunks: list | None  # (trunk index, payload offset, first record, records, length); empty: the sidecar; None: all, found by the task
    first_record: int = 0


class TrunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mode = options["path"], options.get("mode", "permissive").lower()
        self.buffer = options.get("includebuffer", options.get("includeBuffer", "true")).lower() == "true"
        self.bounds = {"record_index": [0, None], "trunk_index": [0, None], "timestamp_millis": [0, None]}

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            kind, value = type(f).__name__, getattr(f, "value", None)
            if name in self.bounds and isinstance(value, int):
                low, high = self.bounds[name]
                if kind in ("EqualTo", "GreaterThanOrEqual", "GreaterThan"):
                    self.bounds[name][0] = max(low, value + (kind == "GreaterThan"))
                if kind in ("EqualTo", "LessThanOrEqual", "LessThan"):
                    top = value - (kind == "LessThan")
                    self.bounds[name][1] = top if high is None else min(high, top)
            yield f

    def _wanted(self, i: int, first: int, count: int) -> bool:
        (a, b), (c, d) = self.bounds["record_index"], self.bounds["trunk_index"]
        return first + count > a and (b is None or first <= b) and i >= c and (d is None or i <= d)

    def _chosen(self, file: str, size: int, header: dict, before: int) -> list[tuple[int, int, int, int, int]]:
        return [(i, at, before + first, n, length) for i, (at, first, n, length) in enumerate(file_index(file, size, header, self.mode)) if self._wanted(i, before + first, n)]

    def partitions(self):
        out, files = [], log_files(self.path)
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(file_header, files))
        walked, before = len(files) <= WALKED_FILES, 0
        latest = self.bounds["timestamp_millis"][1]
        for file, (size, header) in zip(files, headers):
            records = header["records"] if header else 0
            late = header is not None and latest is not None and header["base"] > latest
            if header and not late and (self.mode == "strict" or not records or self._reaches(before, records)):
                if walked:
                    chosen = self._chosen(file, size, header, before)
                    out += [Trunks(file, header["base"], header["codec"], chosen[lo : lo + TRUNKS_PER_TASK]) for lo in range(0, len(chosen), TRUNKS_PER_TASK)]
                else:
                    out.append(Trunks(file, header["base"], header["codec"], None, before))
            before += records
            if self.buffer and store.size(file + ".buffer") > 8:
                out.append(Trunks(file, 0, "none", [], before))
        return out or [Trunks(self.path, 0, "none", [], -1)]

    def _reaches(self, before: int, records: int) -> bool:
        """Whether the file may hold wanted records; trunk numbers say nothing about whole files."""
        low, high = self.bounds["record_index"]
        return before + records > low and (high is None or before <= high)

    def trunks_of(self, partition: Trunks) -> list:
        if partition.trunks is not None:
            return partition.trunks
        size, header = file_header(partition.file)
        return self._chosen(partition.file, size, header, partition.first_record)

    def read(self, partition: Trunks) -> Iterator[pa.RecordBatch]:
        if partition.first_record < 0:
            return
        if partition.trunks is not None and not partition.trunks:
            with store.reader(partition.file + ".buffer") as f:
                base = int.from_bytes(f.read(8), "big")
                yield self._batch(partition, decode_columns(f.read(), partial=True), base, -1, partition.first_record, True)
            return
        with store.reader(partition.file) as f:
            for i, offset, first, count, length in self.trunks_of(partition):
                f.seek(offset)
                yield self._batch(partition, decode_columns(decompress(f.read(length), partition.codec), count), partition.base, i, first, False)

    def _batch(self, part: Trunks, lines: tuple, base: int, trunk: int, first: int, buffered: bool) -> pa.RecordBatch:
        offsets, ids, texts = lines
        n = len(offsets)
        word = pa.array(["trunk"], pa.string())
        same = lambda value: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), value).dictionary_decode()
        attributes = pa.MapArray.from_arrays(np.arange(n + 1, dtype=np.int32), same(pa.array(["format"], pa.string())), same(word))
        columns = [
            pa.array(offsets + base), pa.array(offsets), pa.DictionaryArray.from_arrays(pa.array(ids.astype(np.int32)), pa.array(LEVELS)).dictionary_decode(), pa.array(ids.astype(np.int32)),
            same(word), same(word), texts.cast(pa.string()), attributes, same(pa.array([local(part.file)], pa.string())),
            pa.nulls(n, pa.int32()) if trunk < 0 else pa.array(np.full(n, trunk, np.int32)), pa.array(np.arange(first, first + n)), pa.array(np.full(n, buffered)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int
    trunks: int = 0
    part: int = 0
    first: int = 0
    last: int = 0


class TrunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.codec = codec_by_name(options.get("compression", "gzip"))
        self.prefix = options.get("prefix", "")
        self.kb = min(65_535, max(1, int(options.get("trunksizekb", options.get("trunkSizeKb", DEFAULT_TRUNK_KB)))))
        base = options.get("basemillis", options.get("baseMillis"))
        self.base = None if base is None else int(base)
        self.single = options.get("singlefile", options.get("singleFile", "false")).lower() == "true"
        if self.single and self.base is None:
            raise ValueError("singleFile needs baseMillis, which all tasks' offsets count from")

    def write(self, iterator) -> Written:
        """Trunks go to a body file; the header, which counts them, is put before them when the job commits."""
        from pyspark import TaskContext

        part, packer, out, name, first = TaskContext.get().partitionId(), TrunkPacker(self.codec, self.kb, self.base), None, "", 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            millis, levels = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("timestamp_millis", "level_id"))
            if out is None:
                folder = self.path + "-parts" if self.single else self.path
                name = store.join(folder, f"{self.prefix}part-{part:05d}-{uuid.uuid4().hex[:8]}.tog")
                out, first = store.writer(name + PENDING), int(millis[0])
                out.write(bytes(HEADER.size) if store.local_path(name) is not None and not self.single else b"")
            out.write(packer.add(millis, levels, *text_column(batch.column(names.index("message")))))
        if out is None:
            return Written("", 0)
        out.write(packer.rest())
        if not self.single and store.local_path(name) is not None:
            out.seek(0)
            out.write(self._header(packer.base, packer.records, packer.trunks))
        out.close()
        if not self.single and store.local_path(name) is None:  # streams of other stores can't go back
            with store.writer(name + ".whole" + PENDING) as whole:
                whole.write(self._header(packer.base, packer.records, packer.trunks))
                store.append_to(whole, name + PENDING)
            store.remove(name + PENDING)
            store.rename(name + ".whole" + PENDING, name + PENDING)
        return Written(name, packer.records, packer.trunks, part, first, packer.last)

    def _header(self, base: int, records: int, trunks: int) -> bytes:
        return write_header(self.codec, self.kb, base, records, trunks)

    def commit(self, messages) -> None:
        done = sorted((m for m in messages if m and m.file), key=lambda m: m.part)
        if self.single:
            merge_parts(self.path, [(m.file + PENDING, m.records, m.trunks, m.first, m.last) for m in done], self.codec, self.kb, self.base)
            store.remove_folder(self.path + "-parts") if done else None
            return
        old = (store.listed(self.path, ".tog", self.prefix) or []) if self.overwrite else []
        for m in done:
            store.rename(m.file + PENDING, m.file)
        for f in old:
            store.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.file:
                store.remove(m.file + PENDING)


def merge_parts(path: str, parts: list[tuple[str, int, int, int, int]], codec: str, trunk_kb: int, base: int) -> None:
    """One file of the trunks in ``parts`` (file of trunks, records, trunks, first and last time), in order, behind one header."""
    for (name, *_, last), (_, _, _, first, _) in zip(parts, parts[1:]):
        if first < last:
            raise ValueError(f"records must not go back in time: after {name}")
    with store.writer(path + PENDING) as out:
        out.write(write_header(codec, trunk_kb, base, sum(p[1] for p in parts), sum(p[2] for p in parts)))
        for p in parts:
            store.append_to(out, p[0])
    store.rename(path + PENDING, path)


class TrunkLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trunklog"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema: StructType) -> TrunkReader:
        return TrunkReader(dict(self.options))

    def streamReader(self, schema: StructType):
        from trunkline.streaming.tail import TailReader

        return TailReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TrunkWriter:
        return TrunkWriter(dict(self.options), overwrite)


class IndexReader(TrunkReader):
    def read(self, partition: Trunks) -> Iterator[tuple]:
        if partition.first_record >= 0:
            for i, offset, first, count, length in self.trunks_of(partition):
                yield local(partition.file), i, offset, first, count, length


class TrunkLogIndex(DataSource):
    """Trunk headers only: (file, trunk_index, start_offset, record_start_index, line_count, compressed_length)."""

    @classmethod
    def name(cls) -> str:
        return "trunklog_index"

    def schema(self) -> str:
        return "file string, trunk_index int, start_offset long, record_start_index long, line_count int, compressed_length long"

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader({**dict(self.options), "includeBuffer": "false", "includebuffer": "false"})


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self):
        files = log_files(self.path)
        return [InputPartition(files[lo : lo + 1000]) for lo in range(0, len(files), 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in partition.value:
            size, h = file_header(file)
            if h is not None:
                yield local(file), h["version"], h["codec"], h["trunk_kb"], h["base"], h["records"], h["trunks"], size


class TrunkLogHeader(DataSource):
    """File headers only: (file, version, compression, trunk_size_kb, base_timestamp_millis, total_records, trunk_count, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "trunklog_header"

    def schema(self) -> str:
        return "file string, version string, compression string, trunk_size_kb int, base_timestamp_millis long, total_records long, trunk_count int, bytes long"

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(dict(self.options))


def register(spark) -> None:
    from trunkline.sources.plaintext import PlainLog

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TrunkLog, TrunkLogIndex, TrunkLogHeader, PlainLog):
        spark.dataSource.register(source)


def scan_bytes(data: bytes) -> list[tuple[int, int, str]]:
    """Strict whole-file parse of bytes: (millis, level id, text)."""
    header = read_header(data)
    index = scan_index(io.BytesIO(data), len(data), header)
    if sum(t[2] for t in index) != header["records"] or (index[-1][0] + index[-1][3] if index else HEADER.size) != len(data):
        raise ValueError("the header's counts and the file differ")
    return [(header["base"] + o, level, text) for at, _, n, length in index for o, level, text in decode_lines(decompress(data[at : at + length], header["codec"]), n)]


class TrunkFile:
    """A trunk file that grows record by record on one machine, with a sidecar for what no trunk holds yet.

    Each record goes to ``<path>.buffer`` first (behind the base time), so that a reader or a restart
    after a crash finds it. A flush compresses the records held, appends the trunk, counts it in
    the header in place, and empties the sidecar. Opening truncates an existing file, unless
    ``recover``: then trunks and sidecar records stay, and appending goes on after them.
    """

    def __init__(self, path: str, codec: str = "gzip", trunk_kb: int = DEFAULT_TRUNK_KB, recover: bool = False) -> None:
        if store.local_path(path) is None:
            raise ValueError("a file that is changed in place must be local")
        path = local(path)
        self.path, self.codec, self.kb = path, codec_by_name(codec), min(65_535, max(1, trunk_kb))
        self.base = self.last = None
        self.records = self.trunks = 0
        held: list[tuple[int, int, str]] = []
        if recover and store.size(path):
            held = self._recover()
        else:
            with store.writer(path):
                pass
        self.file, self.buffer = open(path, "r+b"), open(path + ".buffer", "w+b")
        self.file.seek(0, 2)
        self.lines, self.held, self.bytes = [], 0, 0
        for millis, level, text in held:
            self.append(millis, level, text)

    def _recover(self) -> list[tuple[int, int, str]]:
        size, header = file_header(self.path)
        self.codec, self.kb, self.base, self.records, self.trunks = header["codec"], header["trunk_kb"], header["base"], header["records"], header["trunks"]
        index = file_index(self.path, size, header, "index")
        with open(self.path, "r+b") as f:
            f.truncate(index[-1][0] + index[-1][3] if index else HEADER.size)  # a trunk that the header doesn't name was not finished
            if index:
                f.seek(index[-1][0])
                self.last = header["base"] + int(decode_columns(decompress(f.read(index[-1][3]), self.codec), index[-1][2])[0].max())
        if store.size(self.path + ".buffer") <= 8:
            return []
        with open(self.path + ".buffer", "rb") as f:
            base = int.from_bytes(f.read(8), "big")
            return [(base + o, level, text) for o, level, text in decode_lines(f.read(), partial=True)]

    def append(self, millis: int, level_id: int, text: str) -> None:
        from trunkline.sources.codec import encode_line

        if millis < 0 or (self.last is not None and millis < self.last):
            raise ValueError("records must not go back in time")
        base = millis if self.base is None else self.base
        line = encode_line(millis - base, level_id, text.encode("utf-8"))
        if self.base is None:
            self.base = base
            self._write_header()
        if self.lines and (len(self.lines) == MAX_TRUNK_RECORDS or self.bytes + len(line) > self.kb * 1024):
            self.flush()
        if self.buffer.tell() == 0:
            self.buffer.write(self.base.to_bytes(8, "big"))
        self.buffer.write(line)
        self.buffer.flush()
        self.lines.append(line)
        self.bytes += len(line)
        self.last = millis
        if self.bytes >= self.kb * 1024:
            self.flush()

    def _write_header(self) -> None:
        self.file.seek(0)
        self.file.write(write_header(self.codec, self.kb, self.base or 0, self.records, self.trunks))
        self.file.seek(0, 2)
        self.file.flush()

    def flush(self) -> None:
        from trunkline.sources.codec import compress

        if not self.lines:
            return
        body = compress(b"".join(self.lines), self.codec)
        self.file.seek(0, 2)
        self.file.write(TRUNK.pack(len(self.lines), len(body)) + body)
        self.file.flush()
        self.records, self.trunks = self.records + len(self.lines), self.trunks + 1
        self._write_header()
        self.buffer.seek(0)
        self.buffer.truncate()
        self.lines, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        if self.base is None:
            self._write_header()
        self.file.close()
        self.buffer.close()

    def __enter__(self) -> TrunkFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()
