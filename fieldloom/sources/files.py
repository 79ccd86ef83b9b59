"""Listing and opening files by path or URI, on the driver and in tasks."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system, under the name that Arrow has for the scheme, and the path in it."""
    if not ("://" in path or path.startswith("file:")):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Path and size of the files of a folder whose names match, or of the file itself: one look at the folder."""
    s, p = store(path)
    info = s.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = sorted((f.base_name, f.size) for f in s.get_file_info(fs.FileSelector(p)) if f.type == fs.FileType.File)
    return [(posixpath.join(path, n), size) for n, size in found if fnmatch.fnmatch(n, pattern)]


def find(path: str, pattern: str) -> list[str]:
    """Files of a folder whose names match, or the file itself."""
    return [f for f, _ in listed(path, pattern)]


#: Parts that are left as they are, one a task; what a part counts besides its bytes.
TASKS, OPENING = 32, 4096


def packed(parts: list, sizes: list[int], tasks: int, most: int) -> list[list]:
    """Neighbours in groups of like size, about ``tasks`` of them or, if these would exceed ``most`` bytes, more. Up to ``tasks`` parts stay alone."""
    if len(parts) <= tasks:
        return [[p] for p in parts]
    sizes = [n + OPENING for n in sizes]
    size, before, groups = min(most, max(1, sum(sizes) / tasks)), 0, {}
    for p, n in zip(parts, sizes, strict=True):
        groups.setdefault(int((before + n / 2) / size), []).append(p)
        before += n
    return list(groups.values())


def joined(batches: Iterable[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def create(path: str):
    """A new file for bytes; its folder is made."""
    s, p = store(path)
    s.create_dir(posixpath.dirname(p), recursive=True)
    return s.open_output_stream(p)


def open_(path: str):
    s, p = store(path)
    return s.open_input_file(p)


def size_of(path: str) -> int:
    s, p = store(path)
    return s.get_file_info(p).size


def drop_folder(path: str) -> None:
    s, p = store(path)
    if s.get_file_info(p).type == fs.FileType.Directory:
        s.delete_dir(p)
