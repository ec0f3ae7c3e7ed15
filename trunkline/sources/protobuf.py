"""Records and queries as protocol buffer messages, in the wire format itself.

Record: 1 time stamp (varint), 2 severity id + 1 (varint), 3 source, 4 context, 5 message
(strings), 6 attributes (map). Query: 1 start, 2 end, 3 minimum severity, 4 keyword, each in a
wrapper message, so that an absent one stays absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trunkline.operators.query import LogQuery
from trunkline.schema import LEVELS

FIELDS = "timestamp_millis long, level_id int, source string, context string, message string, attributes map<string,string>"
MAX = 1 << 64


def varint(n: int) -> bytes:
    out = bytearray()
    n %= MAX
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(tag: int, n: int) -> bytes:
    return varint(tag << 3) + varint(n) if n else b""


def block(tag: int, data: bytes, always: bool = False) -> bytes:
    return varint(tag << 3 | 2) + varint(len(data)) + data if data or always else b""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(tag, number or bytes) in order; other wire types are skipped over."""
    at = 0

    def take() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("a message is truncated")
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n % MAX

    while at < len(data):
        key = take()
        kind = key & 7
        if kind == 0:
            yield key >> 3, take()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else take()
        if size is None or at + size > len(data):
            raise ValueError("a message is truncated or of an unknown form")
        at += size
        if kind == 2:
            yield key >> 3, data[at - size : at]


def encode_record(millis: int, level_id: int, source: str | None, context: str | None, message: str | None, attributes: dict | None) -> bytes:
    """Nulls are empty."""
    texts = b"".join(block(tag, (t or "").encode()) for tag, t in ((3, source), (4, context), (5, message)))
    pairs = b"".join(block(6, block(1, k.encode()) + block(2, (v or "").encode()), True) for k, v in dict(attributes or {}).items())
    return number(1, millis or 0) + number(2, level_id + 1) + texts + pairs


def decode_record(data: bytes) -> tuple:
    millis, level, texts, pairs = 0, 0, {3: "", 4: "", 5: ""}, {}
    for tag, value in fields(data):
        if tag == 1:
            millis = value
        elif tag == 2:
            level = value
        elif tag in texts:
            texts[tag] = value.decode()
        elif tag == 6:
            pair = dict(fields(value))
            pairs[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
    if not 1 <= level <= len(LEVELS):
        raise ValueError(f"no such severity: {level}")
    return millis, level - 1, texts[3], texts[4], texts[5], pairs


class ProtobufCodec:
    """One record at a time: (millis, level id, source, context, message, attributes) to bytes and back."""

    name = "protobuf"

    def encode(self, record: tuple) -> bytes:
        return encode_record(*record)

    def decode(self, data: bytes) -> tuple:
        return decode_record(data)


def encode_query(q: LogQuery) -> bytes:
    level = None if q.minimum_level is None else LEVELS.index(q.minimum_level) + 1
    numbers = b"".join(block(tag, number(1, n), True) for tag, n in ((1, q.start), (2, q.end), (3, level)) if n is not None)
    return numbers + (b"" if q.keyword is None else block(4, block(1, q.keyword.encode()), True))


def decode_query(data: bytes) -> LogQuery:
    got = {tag: dict(fields(value)).get(1) for tag, value in fields(data)}
    level = LEVELS[int(got[3] or 0) - 1] if 3 in got and 1 <= int(got[3] or 0) <= len(LEVELS) else None
    if 3 in got and level is None:
        raise ValueError("no such severity")
    return LogQuery(*(int(got[t] or 0) if t in got else None for t in (1, 2)), level, (got[4] or b"").decode() if 4 in got else None)


def encoded_records(records: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([encode_record(*r) for r in rows], pa.binary())], names=["message"])

    names = [f.split()[0] for f in FIELDS.split(", ")]
    return records.select(F.col(names[0]).cast("long"), F.col(names[1]).cast("int"), *names[2:]).mapInArrow(run, "message binary")


def decoded_records(messages: DataFrame) -> DataFrame:
    """The column ``message``, read back; a damaged message is an error."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [decode_record(m) for m in batch.column(0).to_pylist()]
            columns = [pa.array([list(r[j].items()) if j == 5 else r[j] for r in rows], kinds[j]) for j in range(6)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return messages.select("message").mapInArrow(run, FIELDS)
