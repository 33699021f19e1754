"""Files of a shared store, from the driver and executors alike, written under another name and renamed when whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file; its bytes. An interrupted write leaves nothing under the name."""
    files, path = opened(uri)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}-{name}"
    size = 0
    with files.open_output_stream(temporary, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(temporary, path)
    return size


def get(uri: str) -> bytes:
    files, path = opened(uri)
    with files.open_input_file(path) as source:
        return source.read()


class Ranged:
    """Bytes of a file that are read where they are wanted: slices of it, by blocks that are kept, like those of bytes."""

    def __init__(self, uri: str, block: int = 1 << 16, keep: int = 64):
        files, path = opened(uri)
        self.source = files.open_input_file(path)
        self.size, self.block, self.keep = self.source.size(), block, keep
        self.held: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        lo, hi, _ = at.indices(self.size)
        if hi - lo > 8 * self.block:
            return self.source.read_at(hi - lo, lo)
        return b"".join(self.part(k)[max(0, lo - k * self.block) : hi - k * self.block] for k in range(lo // self.block, -(-hi // self.block))) if hi > lo else b""

    def part(self, k: int) -> bytes:
        if k not in self.held:
            if len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            self.held[k] = self.source.read_at(min(self.block, self.size - k * self.block), k * self.block)
        return self.held[k]

    def close(self) -> None:
        self.source.close()


def listed(uri: str) -> list[str]:
    """The files of a folder by name, or the file itself, as URIs."""
    files, path = opened(uri)
    info = files.get_file_info(path)
    scheme = uri.partition("://")[0] + "://" if "://" in uri else ""
    if info.type != fs.FileType.Directory:
        return [uri]
    found = files.get_file_info(fs.FileSelector(path))
    return sorted(f"{scheme}{x.path}" for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def exists(uri: str) -> bool:
    files, path = opened(uri)
    return files.get_file_info(path).type != fs.FileType.NotFound


def copied(uri: str, upto: int, block: int = 1 << 22) -> Iterable[bytes]:
    """The first bytes of a file, a block at a time."""
    files, path = opened(uri)
    with files.open_input_file(path) as source:
        at = 0
        while at < upto and (chunk := source.read_at(min(block, upto - at), at)):
            yield chunk
            at += len(chunk)


def rename(source: str, target: str) -> None:
    files, path = opened(source)
    files.move(path, opened(target)[1])


def remove(uri: str) -> None:
    files, path = opened(uri)
    kind = files.get_file_info(path).type
    if kind == fs.FileType.Directory:
        files.delete_dir(path)
    elif kind == fs.FileType.File:
        files.delete_file(path)
