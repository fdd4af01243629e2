"""Files of a folder that all executors share, on any file system that Arrow knows: local paths, file:, hdfs:, s3: (also s3a:)."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyarrow import fs as pafs

_COPY = 1 << 22


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def files_of(path: str, suffix: str) -> list[str]:
    """The path itself if it is a file, else the files with that ending right in the folder; hidden ones don't count."""
    store, p = open_store(path)
    kind = store.get_file_info(p).type
    if kind == pafs.FileType.File:
        return [path]
    if kind != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    names = [i.base_name for i in store.get_file_info(pafs.FileSelector(p)) if i.type == pafs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(suffix) and not n.startswith(("_", "."))]


def is_folder(path: str) -> bool:
    store, p = open_store(path)
    return store.get_file_info(p).type == pafs.FileType.Directory


def size_of(path: str) -> int:
    store, p = open_store(path)
    info = store.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_at(path: str, start: int, size: int, piece: int = _COPY) -> Iterator[bytes]:
    """`size` bytes from `start`, at most `piece` at once."""
    store, p = open_store(path)
    with store.open_input_file(p) as f:
        f.seek(start)
        while size > 0:
            got = f.read(min(piece, size))
            if not got:
                raise EOFError(f"{path} ends too early")
            size -= len(got)
            yield got


def make_folder(path: str) -> None:
    store, p = open_store(path)
    store.create_dir(p, recursive=True)


def write_bytes(path: str, chunks: Iterator[bytes]) -> int:
    """Writes the chunks one after another; gives the number of bytes."""
    store, p = open_store(path)
    n = 0
    with store.open_output_stream(p) as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    return n


def put_count(path: str, count: int) -> None:
    """Puts a count, 64 bits little-endian, before the bytes of a file: in place where 8 bytes were left free (a local file), else by
    copying, as other stores write a file once."""
    store, p = open_store(path)
    head = struct.pack("<Q", count)
    if isinstance(store, pafs.LocalFileSystem):
        with open(p, "r+b") as f:
            f.write(head)
        return
    copy = f"{p}.counted"
    with store.open_input_stream(p) as a, store.open_output_stream(copy) as b:
        a.read(8)
        b.write(head)
        while got := a.read(_COPY):
            b.write(got)
    store.delete_file(p)
    store.move(copy, p)


def move(path: str, to: str) -> None:
    store, p = open_store(path)
    store.move(p, open_store(to)[1])


def delete(path: str) -> None:
    """Removes a file; one that isn't there is no error."""
    store, p = open_store(path)
    if store.get_file_info(p).type == pafs.FileType.File:
        store.delete_file(p)
