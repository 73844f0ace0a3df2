"""Files that tasks write to and read from the shared folder, through Arrow's file systems."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


class Target:
    """A file that appears under its name only when it is complete; a repeated task replaces it."""

    def __init__(self, folder: str, name: str):
        self.system, path = open_fs(folder)
        self.system.create_dir(path, recursive=True)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.stream = self.system.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> int:
        size = self.stream.tell()
        self.stream.close()
        self.system.move(self.part, self.path)
        return size
