"""Files in the shared folder, for tasks that write or read byte ranges."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    """A new file; its folder is made where the store has folders."""
    path = _local(uri)
    if path is None:
        store, path = _remote(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


class RangeReader:
    """Byte ranges of files; keeps a few of them open."""

    def __init__(self, most: int = 32) -> None:
        self.open, self.most = {}, most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            path = _local(uri)
            if path is None:
                store, path = _remote(uri)
                self.open[uri] = store.open_input_file(path)
            else:
                self.open[uri] = open(path, "rb")
        self.open[uri].seek(offset)
        return self.open[uri].read(length)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()
