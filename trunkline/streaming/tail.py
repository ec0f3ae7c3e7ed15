"""Stream of the records that append-only trunk files gain.

The offset holds for each file the trunks, bytes and records passed so far, so a poll reads only
the headers of new trunks. A trunk counts once the header names it and all its bytes are there;
an unfinished one is left for a later poll. Sidecars are not streamed: their records move into
trunks. Driver state is three numbers a file; the trunks are read by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader

from trunkline.sources import store
from trunkline.sources.codec import HEADER, read_header
from trunkline.sources.trunklog import TRUNKS_PER_TASK, Trunks, TrunkReader, log_files

START = [0, HEADER.size, 0]
TRUNK_HEAD = 6


def new_trunks(file: str, passed: list[int], upto: int | None = None) -> tuple[dict | None, list[tuple[int, int, int, int, int]]]:
    """(header, [(trunk, payload offset, first record, records, payload bytes)]) after ``passed``, before trunk ``upto``."""
    trunk, at, record = passed
    size = store.size(file)
    if size < HEADER.size:
        return None, []
    found = []
    with store.reader(file) as f:
        header = read_header(f.read(HEADER.size))
        last = header["trunks"] if upto is None else upto
        while trunk < last and at + TRUNK_HEAD <= size:
            f.seek(at)
            head = f.read(TRUNK_HEAD)
            count, length = int.from_bytes(head[:2], "big"), int.from_bytes(head[2:], "big")
            if at + TRUNK_HEAD + length > size:
                break
            found.append((trunk, at + TRUNK_HEAD, record, count, length))
            trunk, at, record = trunk + 1, at + TRUNK_HEAD + length, record + count
    return header, found


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.path = options["path"]
        self.seen: dict[str, list[int]] = {}

    def _files(self) -> list[str]:
        return log_files(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file in self._files():
            _, found = new_trunks(file, self.seen.get(file, START))
            if found:
                trunk, at, record, count, length = found[-1]
                self.seen[file] = [trunk + 1, at + length, record + count]
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Trunks]:
        for file, reached in end.items():  # after a restart the offsets come from the checkpoint
            self.seen[file] = max(reached, self.seen.get(file, START))
        out = []
        for file, reached in sorted(end.items()):
            passed = start.get(file, START)
            if reached[0] <= passed[0]:
                continue
            header, found = new_trunks(file, passed, reached[0])
            if len(found) < reached[0] - passed[0]:
                raise ValueError(f"{file}: trunks of an earlier offset are gone")
            out += [Trunks(file, header["base"], header["codec"], found[lo : lo + TRUNKS_PER_TASK]) for lo in range(0, len(found), TRUNKS_PER_TASK)]
        return out

    def read(self, partition: Trunks) -> Iterator[pa.RecordBatch]:
        return TrunkReader(self.options).read(partition)
