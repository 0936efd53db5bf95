"""Byte ranges of files on any file system that pyarrow knows, for readers and writers that run inside tasks."""

from __future__ import annotations

import fnmatch

import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            return pafs.LocalFileSystem(), uri.removeprefix("file:")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def prefix_of(uri: str) -> str:
    """What a path on the URI's file system has to be put behind to be a URI of the same kind."""
    _, path = located(uri)
    return uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"


def listed(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of the files in a folder, or of those that fit a pattern of the last part, in order."""
    system, path = located(uri)
    folder, _, last = path.rpartition("/")
    before = prefix_of(uri)
    if any(c in last for c in "*?["):
        infos = [i for i in system.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, last)]
    elif (info := system.get_file_info(path)).type == pafs.FileType.Directory:
        infos = [i for i in system.get_file_info(pafs.FileSelector(path)) if i.base_name.lower().endswith(endings) and not i.base_name.startswith((".", "_"))]
    elif info.type == pafs.FileType.File:
        infos = [info]
    else:
        raise FileNotFoundError(uri)
    return sorted((before + i.path, i.size) for i in infos if i.type == pafs.FileType.File)


class Ranges:
    """Reads byte ranges of one file and counts what it reads."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file, self.taken = system.open_input_file(path), 0

    def __call__(self, start: int, size: int) -> bytes:
        found = self.file.read_at(size, start)
        self.taken += len(found)
        if len(found) < size:
            raise EOFError(f"{size} bytes at {start} are beyond the file's end")
        return found

    def size(self) -> int:
        return self.file.size()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def put(uri: str, data: bytes) -> None:
    system, path = located(uri)
    with system.open_output_stream(path) as out:
        out.write(data)


def move(source: str, target: str) -> None:
    system, path = located(source)
    system.move(path, located(target)[1])


def remove(uri: str) -> None:
    system, path = located(uri)
    if system.get_file_info(path).type == pafs.FileType.File:
        system.delete_file(path)


def make_folder(uri: str) -> None:
    system, path = located(uri)
    system.create_dir(path, recursive=True)
