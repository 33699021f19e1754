"""Files in the shared folder, from executors and the driver alike, by Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


class Atomic:
    """A file that has its name only once it is whole: it is written under another and renamed on `commit`.

    A task that runs again writes the same bytes under the same final name, so a lost executor leaves no half file
    under a final name.
    """

    def __init__(self, uri: str):
        self.files, self.path = opened(uri)
        self.folder, _, self.name = self.path.rpartition("/")
        self.files.create_dir(self.folder, recursive=True)
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}-{self.name}"
        self.out = self.files.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.files.move(self.temporary, self.path)
        return self.name


def remove(uri: str) -> None:
    files, path = opened(uri)
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)
