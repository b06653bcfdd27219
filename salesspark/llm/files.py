"""Binary files in a shared folder, written by tasks: the folder is a URI that pyarrow's file systems know (file, hdfs, s3, gs)."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark import TaskContext


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``uri``; a URI without scheme is a local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TaskFiles:
    """Files of one task below ``uri``. Each is written under a name of this attempt and gets its own name when it is whole, so
    a repeated task replaces what a lost one has left."""

    def __init__(self, uri: str, suffix: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path, recursive=True)
        task = TaskContext.get()
        self.part, self.attempt, self.suffix = task.partitionId(), task.taskAttemptId(), suffix
        self.uri, self.nth = uri.rstrip("/"), 0

    def write(self, content: bytes) -> str:
        name = f"part-{self.part:06d}-{self.nth:05d}{self.suffix}"
        tried = f"{self.path}/.attempt-{self.attempt}-{name}"
        with self.fs.open_output_stream(tried) as f:
            f.write(content)
        self.fs.move(tried, f"{self.path}/{name}")
        self.nth += 1
        return f"{self.uri}/{name}"


def read_whole(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return f.read()
