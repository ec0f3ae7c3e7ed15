"""Media columns: MPEG transport streams.

``mux`` stores bytes losslessly as a transport stream: a program association table and a program
map table, then packetised elementary packets (PES) of one private data stream, each with a
presentation time stamp and, on its first packet, a program clock reference; every
``RANDOM_ACCESS_EVERY``-th PES is a random-access point and is preceded by the tables again.
``demux`` parses the tables to find the stream, checks the continuity counters of every packet
identifier, reassembles the elementary packets, and lists time stamps and random-access points.

Packets are built and taken apart as arrays of 188-byte lines, one text at a time.
Nulls: a null text is empty. Any text gives a stream; equal texts give equal streams. Extra
columns are ignored, whatever their names, and repeated rows give equal rows; an empty table gives none. A very long
text is one stream of about its own size, and some eight times that in memory.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import documents

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 4096  # payload bytes of a PES packet
CLOCK, UNIT_TICKS = 90_000, 3_600
RANDOM_ACCESS_EVERY = 8
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
PMT = _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


PAT_PACKET, PMT_PACKET = _table_packet(0, PAT), _table_packet(PMT_PID, PMT)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 0xFF, (ticks >> 14) & 0xFE | 1, (ticks >> 7) & 0xFF, (ticks << 1) & 0xFE | 1])


def _unit(payload: bytes, ticks: int, access: bool) -> np.ndarray:
    """Packets of one PES, continuity counters still 0."""
    pes = bytes([0, 0, 1, STREAM_ID]) + (len(payload) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _stamp(ticks) + payload
    first = PACKET - 4 - 8  # after an adaptation field with the clock
    rest = max(0, len(pes) - first)
    full, tail = divmod(rest, PACKET - 4)
    n = 1 + full + (tail > 0)
    out = np.zeros((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10
    head = out[0]
    head[1] |= 0x40
    lone = max(0, first - len(pes))
    head[3] = 0x30
    head[4] = 7 + lone
    head[5] = 0x10 | (0x40 if access else 0)
    head[6:12] = np.frombuffer((((ticks & 0x1FFFFFFFF) << 15) | 0x7E00).to_bytes(6, "big"), np.uint8)
    head[12 : 12 + lone] = 0xFF
    body = np.frombuffer(pes, np.uint8)
    head[12 + lone :] = body[: PACKET - 12 - lone]
    if full:
        out[1 : 1 + full, 4:] = body[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
    if tail:
        stuffing = PACKET - 4 - tail
        end = out[-1]
        end[3] = 0x30
        end[4] = stuffing - 1
        if stuffing > 1:
            end[5] = 0
            end[6 : 4 + stuffing] = 0xFF
        end[4 + stuffing :] = body[first + full * (PACKET - 4) :]
    return out


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload``; no bytes give the tables alone."""
    packets, tables = [], 0
    counter = 0
    for i, lo in enumerate(range(0, len(payload), UNIT_BYTES)):
        access = i % RANDOM_ACCESS_EVERY == 0
        if access:
            pair = np.stack([PAT_PACKET, PMT_PACKET])
            pair[:, 3] |= tables & 15
            tables += 1
            packets.append(pair)
        unit = _unit(payload[lo : lo + UNIT_BYTES], (i * UNIT_TICKS) & 0x1FFFFFFFF, access)
        unit[:, 3] |= ((counter + np.arange(len(unit))) & 15).astype(np.uint8)
        counter += len(unit)
        packets.append(unit)
    return np.concatenate(packets or [np.stack([PAT_PACKET, PMT_PACKET])]).tobytes()


def _checked(section: bytes, table: int) -> bytes:
    size = ((section[1] & 0x0F) << 8 | section[2]) + 3
    if section[0] != table or crc32_mpeg(section[:size]):
        raise ValueError("a program table is damaged")
    return section[8 : size - 4]


def demux(stream: bytes) -> dict:
    """payload, and what the stream says: packets, units, stamps (ticks), access (indices of units), breaks (continuity)."""
    if len(stream) % PACKET:
        raise ValueError("a transport stream is whole packets")
    lines = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(lines) and (lines[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pid = (lines[:, 1].astype(np.int64) & 0x1F) << 8 | lines[:, 2]
    breaks = 0
    for p in np.unique(pid):
        has = lines[(pid == p) & (lines[:, 3] & 0x10 > 0), 3] & 15
        breaks += int(((has[1:] - has[:-1]) & 15 != 1).sum())
    pats = lines[pid == 0]
    out = {"payload": b"", "packets": len(lines), "units": 0, "stamps": [], "access": [], "breaks": breaks}
    if not len(pats):
        return out
    body = _checked(pats[0, 5:].tobytes(), 0)
    programs = {body[i] << 8 | body[i + 1]: (body[i + 2] & 0x1F) << 8 | body[i + 3] for i in range(0, len(body), 4)}
    pmts = lines[pid == programs[PROGRAM]]
    body = _checked(pmts[0, 5:].tobytes(), 2)
    at = 4 + ((body[2] & 0x0F) << 8 | body[3])
    stream_pid = (body[at + 1] & 0x1F) << 8 | body[at + 2]
    own = lines[pid == stream_pid]
    if not len(own):
        return out
    field = np.where(own[:, 3] & 0x20, own[:, 4].astype(np.int64) + 1, 0)
    keep = np.arange(4, PACKET)[None, :] >= 4 + field[:, None]
    starts = np.flatnonzero(own[:, 1] & 0x40)
    flat = own[:, 4:][keep]
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])
    access = (field > 1) & (own[:, 5] & 0x40 > 0)
    parts = []
    for s, e in zip(starts, [*starts[1:], len(own)]):
        pes = flat[ends[s] : ends[e]]
        size = int(pes[4]) << 8 | int(pes[5])
        head = 9 + int(pes[8])
        b = [int(x) for x in pes[9:14]]
        out["stamps"].append((b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1)
        if access[s]:
            out["access"].append(out["units"])
        out["units"] += 1
        parts.append(pes[head : 6 + size].tobytes())
    out["payload"] = b"".join(parts)
    return out


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


STREAMS = "doc_id long, n_bytes long, media binary"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a transport stream."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [b or b"" for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, STREAMS)


def media_features(media: DataFrame) -> DataFrame:
    """Read the streams back: digests, and a feature string of what they hold."""

    def one(key, n_bytes, stream):
        got = demux(stream)
        payload = got["payload"]
        last = got["stamps"][-1] if got["stamps"] else 0
        feature = f"packets={got['packets']};units={got['units']};breaks={got['breaks']};access={','.join(map(str, got['access']))};last={last / CLOCK:.2f}"
        return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, got["stamps"], [got["stamps"][i] for i in got["access"]]

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access_stamps"]
    ints, text = pa.int64(), pa.string()
    kinds = [ints, ints, ints, text, ints, ints, text, text, pa.list_(ints), pa.list_(ints)]

    def run(batches):
        for batch in batches:
            rows = [one(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(len(names))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, access_stamps array<long>"
    return media.mapInArrow(run, schema)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, stamps, access_stamps."""
    return media_features(media_column(documents(spark, sf_dir)))


_TABLES = "".join(f"'47{pid}' || printf('%02X', 16 | ((i // 8) % 16)) || '{packet[4:].tobytes().hex().upper()}' || " for pid, packet in (("4000", PAT_PACKET), ("4100", PMT_PACKET)))
#: The multiplexer's layout once more, in hexadecimal digits: PES header and payload, first packet, full packets, stuffed last packet.
ORACLE = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS remainders FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) t(i))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, strlen(h) // 2 AS n_bytes, rpad(h, greatest(128, (strlen(h) + 127) // 128 * 128)::INT, '0') AS h FROM d),
u AS (SELECT doc_id, i, i * {UNIT_TICKS} AS t, substr(h, i * {2 * UNIT_BYTES} + 1, {2 * UNIT_BYTES}) AS body FROM p, LATERAL (SELECT unnest(range(0, (strlen(h) + {2 * UNIT_BYTES - 1}) // {2 * UNIT_BYTES})) AS i)),
e AS (SELECT doc_id, i, t, strlen(body) // 2 AS l, '000001BD' || printf('%04X', strlen(body) // 2 + 8) || '848005'
  || printf('%02X%02X%02X%02X%02X', 33 | ((t >> 29) & 14), (t >> 22) & 255, ((t >> 14) & 254) | 1, (t >> 7) & 255, ((t << 1) & 254) | 1) || body AS pes FROM u),
k AS (SELECT *, greatest(0, l - 162) AS rest, 1 + (greatest(0, l - 162) + 183) // 184 AS n FROM e),
c AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n)::BIGINT AS cc FROM k),
m AS (SELECT doc_id, i, t, n, CASE WHEN i % {RANDOM_ACCESS_EVERY} = 0 THEN {_TABLES} '' ELSE '' END
  || '474101' || printf('%02X%02X', 48 | (cc % 16), 7 + greatest(0, 162 - l)) || CASE WHEN i % {RANDOM_ACCESS_EVERY} = 0 THEN '50' ELSE '10' END || printf('%012X', (t << 15) | 32256)
  || repeat('FF', greatest(0, 162 - l)) || substr(pes, 1, 2 * least(176, l + 14))
  || coalesce(array_to_string(list_transform(range(1, n), lambda j: '470101' || CASE WHEN 184 * j <= rest THEN printf('%02X', 16 | ((cc + j) % 16)) || substr(pes, 2 * (176 + 184 * (j - 1)) + 1, 368)
    ELSE printf('%02X%02X', 48 | ((cc + j) % 16), 183 - rest % 184) || CASE WHEN rest % 184 < 183 THEN '00' || repeat('FF', 182 - rest % 184) ELSE '' END || substr(pes, 2 * (176 + 184 * (j - 1)) + 1, 2 * (rest % 184)) END), ''), '') AS media FROM c),
g AS (SELECT doc_id, string_agg(media, '' ORDER BY i) AS media, count(*) AS units, sum(n)::BIGINT AS n, list(t ORDER BY i) AS stamps, list(t ORDER BY i) FILTER (i % {RANDOM_ACCESS_EVERY} = 0) AS access_stamps, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (i % {RANDOM_ACCESS_EVERY} = 0) AS access FROM m GROUP BY doc_id)
SELECT p.doc_id, p.n_bytes, strlen(p.h) // 2 AS payload_bytes, sha256(unhex(p.h)) AS payload_sha256,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(64), lambda b: ('0x' || substr(p.h, strlen(p.h) - 127 + 2 * b, 2))::BIGINT)), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]))) AS tail_crc32,
  strlen(g.media) // 2 AS media_bytes, sha256(unhex(g.media)) AS media_sha256,
  'packets=' || (g.n + 2 * ((g.units + {RANDOM_ACCESS_EVERY - 1}) // {RANDOM_ACCESS_EVERY})) || ';units=' || g.units || ';breaks=0;access=' || g.access || ';last=' || printf('%.2f', (g.units - 1) * {UNIT_TICKS} / {CLOCK}.0) AS feature,
  g.stamps, g.access_stamps
FROM p JOIN g ON g.doc_id = p.doc_id, crc
"""
