"""Bytes of trunk files: header, trunks, record lines, compression. No Spark here.

All integers are big-endian. Header: version 3 bytes, compression u16, trunk size in KB u16, base
time i64, records u64, trunks u24. Trunk: records u16, payload length u32, payload. Record: offset
u32, level u8, length u32, UTF-8 text. Compression ids and sizes are fixed values of the format.
"""

from __future__ import annotations

import bz2
import functools
import gzip
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from trunkline.schema import LEVELS, MAX_OFFSET, MAX_TRUNK_RECORDS, MAX_TRUNKS


class Layout:
    """A struct layout that can be sent to Python workers."""

    def __init__(self, form: str) -> None:
        self.form, self.size = form, struct.calcsize(form)

    def pack(self, *values) -> bytes:
        return struct.pack(self.form, *values)

    def unpack(self, data: bytes) -> tuple:
        return struct.unpack(self.form, data)

    def unpack_from(self, data: bytes, at: int) -> tuple:
        return struct.unpack_from(self.form, data, at)


HEADER, TRUNK, LINE = Layout(">3sHHqq3s"), Layout(">HI"), Layout(">IBI")
VERSION = (0, 1, 0)
CODECS = ["none", "gzip", "zip", "deflate", "bzip2", "xz", "zstd", "snappy"]
DEFAULT_TRUNK_KB = 512


def _crc32c_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return out


_CRC32C = _crc32c_table()
_CRC32C_LIST = _CRC32C.tolist()


@functools.cache
def _zeros_operator(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of each of the 32 bits of a remainder."""
    one = np.array([1 << i for i in range(32)], dtype=np.uint32)
    step = (one >> np.uint32(8)) ^ _CRC32C[one & np.uint32(0xFF)]
    out = one
    while length:
        if length & 1:
            out = _applied(step, out)
        step = _applied(step, step)
        length >>= 1
    return out


def _applied(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (values[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits, operator[None, :], np.uint32(0)), axis=1)


def crc32c(data: bytes, lanes: int = 1024) -> int:
    """CRC-32C; long data are taken in ``lanes`` parts at once, whose remainders are then put together in pairs."""
    x = np.frombuffer(data, np.uint8)
    width = len(x) // lanes
    c = 0xFFFFFFFF
    if width >= 8:
        state = np.zeros(lanes, dtype=np.uint32)
        state[0] = c
        for column in np.ascontiguousarray(x[: width * lanes].reshape(lanes, width).T):
            state = (state >> np.uint32(8)) ^ _CRC32C[(state ^ column) & np.uint32(0xFF)]
        x = x[width * lanes :]
        while len(state) > 1:
            state = _applied(_zeros_operator(width), state[::2]) ^ state[1::2]
            width *= 2
        c = int(state[0])
    for b in x.tolist():
        c = (c >> 8) ^ _CRC32C_LIST[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def crc32c_masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def snappy_framed(data: bytes) -> bytes:
    import pyarrow as pa

    codec = pa.Codec("snappy")
    out = [b"\xff\x06\x00\x00sNaPpY"]
    for lo in range(0, len(data), 1 << 16):
        piece = data[lo : lo + (1 << 16)]
        body = crc32c_masked(piece).to_bytes(4, "little") + codec.compress(piece, asbytes=True)
        out.append(b"\x00" + len(body).to_bytes(3, "little") + body)
    return b"".join(out)


def snappy_unframed(data: bytes) -> bytes:
    import pyarrow as pa

    codec, out, at = pa.Codec("snappy"), [], 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            length, shift, i = 0, 0, 4
            while True:
                length |= (body[i] & 0x7F) << shift
                shift += 7
                i += 1
                if body[i - 1] < 0x80:
                    break
            piece = codec.decompress(body[4:], decompressed_size=length, asbytes=True)
        elif kind == 1:
            piece = body[4:]
        elif kind == 0xFF or kind >= 0x80:
            continue
        else:
            raise ValueError(f"a snappy frame has the unknown kind {kind}")
        if crc32c_masked(piece) != int.from_bytes(body[:4], "little"):
            raise ValueError("a snappy frame is damaged")
        out.append(piece)
    return b"".join(out)


def compress(data: bytes, codec: str) -> bytes:
    if codec == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("payload", data)
        return out.getvalue()
    if codec == "deflate":
        press = zlib.compressobj(wbits=-15)
        return press.compress(data) + press.flush()
    if codec == "zstd":
        from zstandard import ZstdCompressor

        return ZstdCompressor().compress(data)
    return {"none": bytes, "gzip": lambda d: gzip.compress(d, 6, mtime=0), "bzip2": bz2.compress, "xz": lzma.compress, "snappy": snappy_framed}[codec](data)


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(z.infolist()[0])
    if codec == "deflate":
        # both dialects are in use: with a zlib header, and raw
        wrapped = len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
        try:
            return zlib.decompress(data, 15 if wrapped else -15)
        except zlib.error:
            return zlib.decompress(data, -15)
    if codec == "zstd":
        from zstandard import ZstdDecompressor

        return ZstdDecompressor().decompressobj().decompress(data)
    return {"none": bytes, "gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress, "snappy": snappy_unframed}[codec](data)


def codec_by_id(ident: int) -> str:
    if not 0 <= ident < len(CODECS):
        raise ValueError(f"no such compression id: {ident}")
    return CODECS[ident]


def codec_by_name(name: str) -> str:
    if name.lower() not in CODECS:
        raise ValueError(f"no such compression: {name}")
    return name.lower()


def write_header(codec: str, trunk_kb: int, base: int, records: int, trunks: int) -> bytes:
    if not 1 <= trunk_kb <= 65_535 or base < 0 or not 0 <= trunks <= MAX_TRUNKS:
        raise ValueError("a header field is out of range")
    return HEADER.pack(bytes(VERSION), CODECS.index(codec), trunk_kb, base, records, trunks.to_bytes(3, "big"))


def read_header(data: bytes) -> dict:
    if len(data) < HEADER.size:
        raise ValueError("the file is truncated: no whole header")
    version, codec, kb, base, records, trunks = HEADER.unpack(data[: HEADER.size])
    if kb < 1 or records < 0 or base < 0:
        raise ValueError("a header field is out of range")
    return {"version": ".".join(map(str, version)), "codec": codec_by_id(codec), "trunk_kb": kb, "base": base, "records": records, "trunks": int.from_bytes(trunks, "big")}


def encode_line(offset: int, level_id: int, text: bytes) -> bytes:
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError("a record's offset is out of range")
    return LINE.pack(offset, level_id, len(text)) + text


def decode_lines(payload: bytes, count: int | None = None, partial: bool = False) -> Iterator[tuple[int, int, str]]:
    """(offset, level id, text) of ``count`` lines, or of all; ``partial``: an incomplete last one is dropped."""
    at = n = 0
    while (count is None and at < len(payload)) or (count is not None and n < count):
        if at + LINE.size > len(payload) or at + LINE.size + LINE.unpack_from(payload, at)[2] > len(payload):
            if partial:
                return
            raise ValueError("a trunk's payload is truncated")
        offset, level, size = LINE.unpack_from(payload, at)
        if level >= len(LEVELS):
            raise ValueError(f"no such level id: {level}")
        at += LINE.size
        yield offset, level, payload[at : at + size].decode("utf-8")
        at += size
        n += 1
    if at != len(payload):
        raise ValueError("a trunk's payload has trailing bytes")


def pack_trunks(lines: Iterable[bytes], trunk_kb: int = DEFAULT_TRUNK_KB) -> Iterator[tuple[int, bytes]]:
    """Greedy trunks (records, raw bytes): full by count, or when a line would pass the size, or when it is reached."""
    held, size, limit = [], 0, trunk_kb * 1024
    for line in lines:
        if held and (len(held) == MAX_TRUNK_RECORDS or size + len(line) > limit):
            yield len(held), b"".join(held)
            held, size = [], 0
        held.append(line)
        size += len(line)
        if size >= limit:
            yield len(held), b"".join(held)
            held, size = [], 0
    if held:
        yield len(held), b"".join(held)


def raw_lines(offsets: np.ndarray, levels: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded lines of many records as one array, and where each begins; ``at`` has the texts' bounds in ``text``."""
    if len(offsets) and not (0 <= offsets.min() and offsets.max() <= MAX_OFFSET):
        raise ValueError("a record's offset is out of range")
    if len(levels) and not (0 <= levels.min() and levels.max() < len(LEVELS)):
        raise ValueError("no such level id")
    sizes = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(sizes + LINE.size)])
    out = np.empty(int(begin[-1]), np.uint8)
    head = begin[:-1]
    for k in range(4):
        out[head + k] = (offsets >> (24 - 8 * k)) & 0xFF
        out[head + 5 + k] = (sizes >> (24 - 8 * k)) & 0xFF
    out[head + 4] = levels
    body = np.ones(len(out), dtype=bool)
    body[(head[:, None] + np.arange(LINE.size)).ravel()] = False
    out[body] = text[at[0] : at[-1]]
    return out, begin


def trunk_ends(begin: np.ndarray, trunk_kb: int) -> list[int]:
    """Where greedy trunks end among lines that begin at ``begin``: as ``pack_trunks``, by whole trunks."""
    out, i, n, limit = [], 0, len(begin) - 1, trunk_kb * 1024
    while i < n:
        i = min(max(int(np.searchsorted(begin, begin[i] + limit, side="right")) - 1, i + 1), i + MAX_TRUNK_RECORDS, n)
        out.append(i)
    return out


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def decode_columns(payload: bytes, count: int | None = None, partial: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, level ids, texts) of a payload, as ``decode_lines``; texts are checked to be UTF-8."""
    starts, at, end, unpack = [], 0, len(payload), struct.Struct(">I").unpack_from
    while at < end and (count is None or len(starts) < count):
        stop = at + LINE.size
        if stop > end or (stop := stop + unpack(payload, at + 5)[0]) > end:
            if partial:
                break
            raise ValueError("a trunk's payload is truncated")
        starts.append(at)
        at = stop
    if count is not None and len(starts) < count and not partial:
        raise ValueError("a trunk's payload is truncated")
    if at != end and not partial:
        raise ValueError("a trunk's payload has trailing bytes")
    data, head = np.frombuffer(payload, np.uint8), np.array(starts, dtype=np.int64)
    wide = lambda k: sum(data[head + k + i].astype(np.int64) << (24 - 8 * i) for i in range(4)) if len(head) else np.zeros(0, np.int64)
    levels, sizes = data[head + 4], wide(5)
    if len(levels) and levels.max() >= len(LEVELS):
        raise ValueError(f"no such level id: {levels.max()}")
    body = np.ones(at, dtype=bool)
    body[(head[:, None] + np.arange(LINE.size)).ravel()] = False
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(head), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[:at][body].tobytes())])
    texts.validate(full=True)
    return wide(0), levels, texts


class TrunkPacker:
    """Compressed trunks of a growing run of records, in order of time."""

    def __init__(self, codec: str, trunk_kb: int, base: int | None = None) -> None:
        self.codec, self.trunk_kb, self.base, self.last = codec, trunk_kb, base, None
        self.records = self.trunks = 0
        self.raw, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def add(self, millis: np.ndarray, levels: np.ndarray, at: np.ndarray, text: np.ndarray) -> bytes:
        """Take records; returns the trunks that they complete."""
        if not len(millis):
            return b""
        if millis.min() < 0 or (np.diff(millis) < 0).any() or (self.last is not None and millis[0] < self.last):
            raise ValueError("records must not go back in time")
        self.base, self.last = int(millis[0]) if self.base is None else self.base, int(millis[-1])
        raw, begin = raw_lines(millis - self.base, levels, at, text)
        self.raw, self.begin = np.concatenate([self.raw, raw]), np.concatenate([self.begin, begin[1:] + self.begin[-1]])
        return self._out(whole=False)

    def rest(self) -> bytes:
        return self._out(whole=True)

    def _out(self, whole: bool) -> bytes:
        ends = trunk_ends(self.begin, self.trunk_kb)
        n = len(self.begin) - 1
        if ends and not whole:
            first = ends[-2] if len(ends) > 1 else 0
            if n - first < MAX_TRUNK_RECORDS and self.begin[n] - self.begin[first] < self.trunk_kb * 1024:
                ends.pop()
        out, i = [], 0
        for j in ends:
            body = compress(self.raw[self.begin[i] : self.begin[j]].tobytes(), self.codec)
            out.append(TRUNK.pack(j - i, len(body)) + body)
            self.records, self.trunks, i = self.records + j - i, self.trunks + 1, j
        self.raw, self.begin = self.raw[self.begin[i] :], self.begin[i:] - self.begin[i]
        return b"".join(out)


def encode_file(records: Iterable[tuple[int, int, str]], codec: str = "gzip", trunk_kb: int = DEFAULT_TRUNK_KB) -> bytes:
    """A whole file from (millis, level id, text) in order of time."""
    base = last = None

    def lines():
        nonlocal base, last
        for millis, level, text in records:
            if millis < 0 or (last is not None and millis < last):
                raise ValueError("records must not go back in time")
            base, last = millis if base is None else base, millis
            yield encode_line(millis - base, level, text.encode("utf-8"))

    out, total, n = [], 0, 0
    for count, raw in pack_trunks(lines(), trunk_kb):
        body = compress(raw, codec)
        out.append(TRUNK.pack(count, len(body)) + body)
        total, n = total + count, n + 1
    return write_header(codec, trunk_kb, base or 0, total, n) + b"".join(out)


def scan_index(data_or_file, size: int, header: dict) -> list[tuple[int, int, int, int]]:
    """(offset of the payload, first record, records, payload length) of each trunk, payloads skipped."""
    out, at, first = [], HEADER.size, 0
    for _ in range(header["trunks"]):
        data_or_file.seek(at)
        head = data_or_file.read(TRUNK.size)
        if len(head) < TRUNK.size or at + TRUNK.size + TRUNK.unpack(head)[1] > size:
            raise ValueError("the file is truncated: a trunk is missing")
        count, length = TRUNK.unpack(head)
        out.append((at + TRUNK.size, first, count, length))
        first, at = first + count, at + TRUNK.size + length
    return out
