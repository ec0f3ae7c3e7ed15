"""Files of any store by URI: plain paths and ``file:`` through the system, everything else through pyarrow."""

from __future__ import annotations

import os
import shutil
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path of a local URI, else None. Plain paths stay as they are, whatever characters they have."""
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme == "file" else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def join(uri: str, name: str) -> str:
    return f"{uri.rstrip('/')}/{name}"


def size(uri: str) -> int:
    """Bytes of a file; 0 if there is none."""
    path = local_path(uri)
    if path is not None:
        return os.path.getsize(path) if os.path.isfile(path) else 0
    store, path = _remote(uri)
    return store.get_file_info(path).size or 0


def listed(uri: str, suffix: str = "", prefix: str = "") -> list[str] | None:
    """URIs of a folder's files, sorted by name; None if it is no folder."""
    path = local_path(uri)
    if path is not None:
        if not os.path.isdir(path):
            return None
        names = [e.name for e in os.scandir(path) if e.is_file()]
    else:
        from pyarrow import fs

        store, path = _remote(uri)
        if store.get_file_info(path).type != fs.FileType.Directory:
            return None
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File]
    return [join(uri, n) for n in sorted(names) if n.endswith(suffix) and n.startswith(prefix)]


def reader(uri: str) -> BinaryIO:
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    store, path = _remote(uri)
    return store.open_input_file(path)


def writer(uri: str) -> BinaryIO:
    """A new file; its folder is made where the store has folders."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "wb")
    store, path = _remote(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def rename(old: str, new: str) -> None:
    path = local_path(old)
    if path is not None:
        os.replace(path, local_path(new))
        return
    store, path = _remote(old)
    store.move(path, _remote(new)[1])


def remove(uri: str) -> None:
    """Remove a file if it is there."""
    path = local_path(uri)
    if path is not None:
        if os.path.exists(path):
            os.remove(path)
        return
    from pyarrow import fs

    store, path = _remote(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)


def remove_folder(uri: str) -> None:
    path = local_path(uri)
    if path is not None:
        shutil.rmtree(path, ignore_errors=True)
        return
    store, path = _remote(uri)
    store.delete_dir(path)


def append_to(target: BinaryIO, uri: str, piece: int = 8 << 20) -> None:
    """Copy a file's bytes to the end of ``target``."""
    with reader(uri) as source:
        while data := source.read(piece):
            target.write(data)
