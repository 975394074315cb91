"""Files that tasks write to the shared folder, by any file system that pyarrow knows.

A task attempt writes a file of its own name and reports it in its rows; once
those rows are staged, only files that they name are read. A retried or
speculative attempt leaves at most an unread file.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(run: Run) -> Run:
    """``run`` of ``mapInArrow``; what its batches took goes back to the system at the end, as idle workers stay."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class PartFile:
    """A file of this task attempt under ``folder``, opened at the first write."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        self.part = context.partitionId() if context else 0
        self.name = f"part-{self.part:06d}-{uuid.uuid4().hex}{suffix}"
        self.uri, self.size = f"{folder}/{self.name}", 0
        self._fs, path = file_system(folder)
        self._fs.create_dir(path, recursive=True)
        self._out = self._fs.open_output_stream(f"{path}/{self.name}", compression=None, buffer_size=1 << 20)

    def write(self, data: bytes) -> int:
        """Where the data starts."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()


def open_input(uri: str):
    """A buffered stream over a file."""
    where, path = file_system(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_random(uri: str):
    where, path = file_system(uri)
    return where.open_input_file(path)
