"""Rows of each partition in a file of the shared folder, so that later steps find them without a shuffle of texts.

A task writes all columns of its rows under a name of its own attempt and gives that name in its result, which Spark
commits; files of other attempts are never read. Decisions about rows are then dealt out by partition number, and
one task reads the file of a partition beside all that was decided about it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa

from llm.tokenfile import open_store


class PartWriter:
    def __init__(self, target: str, part: int):
        self.target, self.part = target, part
        self.store, self.folder = open_store(target)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        self.writer = None

    def write(self, batch: pa.RecordBatch) -> None:
        if self.writer is None:
            self.store.create_dir(self.folder, recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.writer = pa.ipc.new_stream(self.out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1)))
        self.writer.write_batch(batch)

    def close(self) -> str | None:
        """The file, or nothing if there was no row."""
        if self.writer is None:
            return None
        self.writer.close()
        self.out.close()
        return f"{self.target}/{self.name}"


def read_part(path: str) -> Iterator[pa.RecordBatch]:
    folder, _, name = path.rpartition("/")
    store, folder = open_store(folder)
    with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
        yield from pa.ipc.open_stream(file)
