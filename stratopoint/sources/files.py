"""File access shared by the point formats: local paths and any URI Arrow knows."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

import pyarrow.fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


PUBLISHED = "_published"            # names of the files that make up a written folder, one a line


def published(path: str) -> list[str] | None:
    """The names a writer has published in a folder; None for a folder that no writer of this package made."""
    fs, p = open_fs(posixpath.join(path, PUBLISHED))
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_file(p) as f:
        return f.read().decode().split()


def replace_file(source: str, target: str) -> None:
    """Rename, over an older file if there is one; both are paths as Arrow's file system of ``target`` sees them."""
    fs, t = open_fs(target)
    s = open_fs(source)[1]
    try:
        fs.move(s, t)
    except OSError:                  # some stores do not rename onto an existing name
        if fs.get_file_info(t).type != pafs.FileType.File or fs.get_file_info(s).type != pafs.FileType.File:
            raise
        fs.delete_file(t)
        fs.move(s, t)


def publish(path: str, names: Sequence[str], scratch: str) -> None:
    """Put the list of a folder's files in place, whole: readers see the old list or the new one."""
    fs, p = open_fs(posixpath.join(scratch, PUBLISHED))
    with fs.open_output_stream(p) as out:
        out.write("".join(n + "\n" for n in names).encode())
    replace_file(posixpath.join(scratch, PUBLISHED), posixpath.join(path, PUBLISHED))


def list_files(path: str, suffixes: Sequence[str]) -> list[str]:
    """The file itself, or the matching files below a folder in name order: those its writer has published,
    or all that are not in hidden folders where nothing says who wrote it."""
    fs, p = open_fs(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    named = published(path)
    if named is not None:
        return [posixpath.join(path, n) for n in sorted(named) if n.lower().endswith(tuple(suffixes))]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(p, recursive=True))
             if f.type == pafs.FileType.File and f.path.lower().endswith(tuple(suffixes))
             and not any(part.startswith(("_", ".")) for part in posixpath.relpath(f.path, p).split("/"))]
    prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
    return [prefix + f for f in sorted(found)]


def size_of(path: str) -> int:
    fs, p = open_fs(path)
    return fs.get_file_info(p).size


def read_range(path: str, start: int, length: int | None = None) -> bytes:
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def make_folder(path: str) -> None:
    fs, p = open_fs(path)
    fs.create_dir(p, recursive=True)
