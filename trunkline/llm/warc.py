"""WARC archives with a two-level capture index.

Writing: every row becomes a record in a gzip member of its own. Of rows with equal payloads
that with the smallest page_id is the response; the others become revisits of it, which keep the
payload's digest and length but not its bytes. Archives roll at ``ARCHIVE_BYTES``.

Index: captures are sorted by reversed-host URL key (and page_id) into shards; a shard is a file
of gzip blocks of ``BLOCK_LINES`` lines, and a sparse directory with each block's first key and
byte range. Reading: a lookup finds its shard by the shards' first keys, binary-searches the
directory, reads the one or more blocks, binary-searches their lines, and reads the record's
byte range from its archive.

Files lie in the shared folder under names of their own for each task attempt; the index only lists those
of attempts that were kept, so lost executors and repeated tasks leave stray files at worst.

Nulls: a null payload is empty, a null url has an empty key. A row without page_id is always a
response. Rows that repeat page_id and payload are all of one type. Extra columns are ignored, whatever their names.
A very long payload is one record; an empty table writes no archive and reads nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import documents, fresh_path, grouped_frames, stored
from trunkline.llm.files import RangeReader, create

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 512
#: Captures of an index shard, and record bytes of a reading task.
SHARD_LINES = 500_000
TASK_BYTES = 64 << 20
FETCHED = "2024-01-01T00:00:00Z"
TAB, LINE = "\t", "\n"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.a.org/x?y`` gives ``org,a,www)/x?y``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"\s", "_", (url or "").lower())
    if not host:
        return re.sub(r"\s", "_", (url or "").lower())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return re.sub(r"\s", "_", key + ("?" + parts.query if parts.query else ""))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {FETCHED}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers (lower-case names), payload (None for revisits) and payload length of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "payload": payload if headers["warc-type"] == "response" else None, "length": length}


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha2("html", 256)  # SHA-1, which the records carry, can be made to collide
    named = rows.select("page_id", digest.alias("sha")).where("page_id is not null").distinct()
    first = named.groupBy("sha").agg(F.min("page_id").alias("first"))
    revisits = named.join(first, "sha").where("page_id <> first").withColumnRenamed("first", "refers_to")
    return rows.withColumn("sha", digest).join(revisits, ["page_id", "sha"], "left").drop("sha")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records; returns the captures (key, page_id, file, offset, length) as a stored table."""

    def run(batches):
        out, at, name = None, 0, ""
        for batch in batches:
            got = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    name, at = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = create(name)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(member)
                got.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], kinds[j]) for j in range(5)], names=["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "warc-captures")


def _sort_key(key: str, page_id: int | None) -> str:
    return f"{key}{TAB}{str(-1 if page_id is None else page_id).rjust(20, '0')}"


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Shards of the index in key order: (first sort key, path); one for each partition of the sort."""
    line = F.concat_ws(TAB, "sort_key", "file", "offset", "length")
    keyed = captures.withColumn("sort_key", F.concat_ws(TAB, "key", F.lpad(F.coalesce(F.col("page_id"), F.lit(-1)).cast("string"), 20, "0")))
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // SHARD_LINES))
    # lines compare by UTF-8 bytes, here and in Spark's sort
    ordered = keyed.select("sort_key", line.alias("line")).repartitionByRange(parts, "sort_key").sortWithinPartitions("sort_key")

    def run(batches):
        path = f"{folder}/index-{uuid.uuid4().hex}"
        data, directory, at, held, first = None, [], 0, [], None

        def flush():
            nonlocal at
            block = gzip.compress(LINE.join(held).encode(), 6, mtime=0)
            data.write(block)
            directory.append(TAB.join([*held[0].split(TAB)[:2], str(at), str(len(block))]))
            at += len(block)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if data is None:
                    data, first = create(path + ".blocks"), TAB.join(text.split(TAB)[:2])
                held.append(text)
                if len(held) == block_lines:
                    flush()
                    held = []
        if data is not None:
            if held:
                flush()
            data.close()
            with create(path + ".directory") as f:
                f.write(LINE.join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([path]), pa.array([len(LINE.join(directory).encode())], pa.int64())], names=["first", "path", "directory_bytes"])

    shards = ordered.select("line").mapInArrow(run, "first string, path string, directory_bytes long")
    return sorted(((r[0], r[1], r[2]) for r in shards.collect()), key=lambda r: r[0].encode())  # one row for each partition


class ShardReader:
    """Lookups in one shard."""

    def __init__(self, path: str, directory_bytes: int, reader: RangeReader) -> None:
        self.path, self.reader, self.at = path, reader, -1
        entries = [x.split(TAB) for x in reader.read(path + ".directory", 0, directory_bytes).decode().split(LINE)]
        self.keys = [f"{e[0]}{TAB}{e[1]}".encode() for e in entries]
        self.ranges = [(int(e[2]), int(e[3])) for e in entries]
        self.lines, self.line_keys = [], []

    def _block(self, i: int) -> None:
        if i != self.at:
            self.lines = gzip.decompress(self.reader.read(self.path + ".blocks", *self.ranges[i])).decode().split(LINE)
            self.line_keys = [TAB.join(x.split(TAB)[:2]).encode() for x in self.lines]
            self.at = i

    def find(self, sort_key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; repeats may cross blocks."""
        want = sort_key.encode()
        found = []
        i = max(0, bisect_left(self.keys, want) - 1)
        while i < len(self.keys) and self.keys[i] <= want:
            self._block(i)
            for x in self.lines[bisect_left(self.line_keys, want) : bisect_right(self.line_keys, want)]:
                _, _, file, offset, length = x.split(TAB)
                found.append((file, int(offset), int(length)))
            i += 1
        return found


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_captures(lookups: DataFrame, shards: list[tuple[str, str, int]], payloads: bool = True, record_bytes: int = 0) -> DataFrame:
    """Records of the looked-up (page_id, url) pairs, by way of the index; ``html`` only if asked for.

    ``shards`` has one entry for each partition of the index. Asked-for pairs are distinct; repeated
    rows of the archive come back as often as they were written. Tasks take ranges of the index, as many as there are
    shards, or one for each ``TASK_BYTES`` of ``record_bytes`` if that is more; a shard may be read by several.
    """
    tasks = max(1, len(shards), -(-record_bytes // TASK_BYTES))
    firsts = [s[0].encode() for s in shards]

    def route(batches):
        for batch in batches:
            ids, urls = (c.to_pylist() for c in batch.columns)
            keys = [_sort_key(url_key(u), i) for i, u in zip(ids, urls)]
            yield pa.RecordBatch.from_arrays([pa.array([max(0, bisect_right(firsts, k.encode()) - 1) for k in keys], pa.int32()), pa.array(keys, pa.string())], names=["shard", "key"])

    def run(batches):
        reader = RangeReader()
        for group in grouped_frames((b.to_pandas() for b in batches), ["shard"]):
            # a key that repeats over a shard's end is also in the shards before
            number = int(group["shard"].iloc[0])
            open_shards = {number: ShardReader(shards[number][1], shards[number][2], reader)}
            out = []
            for key in group["key"]:
                n, hits = number, []
                while n >= 0:
                    if n not in open_shards:
                        open_shards[n] = ShardReader(shards[n][1], shards[n][2], reader)
                    hits += open_shards[n].find(key)
                    if firsts[n] < key.encode():
                        break
                    n -= 1
                for file, offset, length in hits:
                    got = parse_record(reader.read(file, offset, length))
                    h, payload = got["headers"], got["payload"]
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (digest32(payload) != digest or len(payload) != got["length"]):
                        raise ValueError(f"a record in {file} is damaged")
                    ident = lambda v: None if v is None or v == "<urn:page:none>" else int(v[10:-1])
                    out.append((ident(h["warc-record-id"]), h.get("warc-target-uri"), got["length"], digest, h["warc-type"], ident(h.get("warc-refers-to")), payload.decode() if payloads and payload is not None else None))
                if len(out) >= 500:
                    yield _read_batch(out)
                    out = []
            yield _read_batch(out)
        reader.close()

    asked = lookups.select(F.col("page_id").cast("long"), F.col("url").cast("string")).distinct()
    routed = asked.mapInArrow(route, "shard int, key string").distinct()
    return routed.repartitionByRange(tasks, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(run, READ)


def _read_batch(out: list[tuple]) -> pa.RecordBatch:
    ints, text = pa.int64(), pa.string()
    kinds = [ints, text, ints, text, text, ints, text]
    return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kinds[j]) for j in range(7)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = documents(spark, sf_dir, "pages")
    folder = fresh_path(spark, "warc")
    captures = write_archives(deduplicated(pages), folder)
    shards = write_index(captures, folder)
    record_bytes = captures.agg(F.sum("length")).first()[0] or 0
    return read_captures(pages, shards, payloads=False, record_bytes=record_bytes).drop("html", "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
