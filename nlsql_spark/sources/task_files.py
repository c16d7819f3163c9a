"""Small files that tasks write and read themselves, in the folder all executors share."""

import uuid

import pyarrow as pa
import pyarrow.parquet as pq


def open_folder(uri: str):
    """A pyarrow file system and the path in it, for a folder as Spark names it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_whole(folder: str, table: pa.Table) -> None:
    """A Parquet file that appears under its name only when it is complete; names are never used twice."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{path}/_{name}.tmp", compression=None) as out:
        pq.write_table(table, out)
    store.move(f"{path}/_{name}.tmp", f"{path}/{name}.parquet")


def read_folder(folder: str) -> list[pa.Table]:
    """The complete files of a folder; none if there is no such folder."""
    from pyarrow import fs

    store, path = open_folder(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))
    out = []
    for name in names:
        with store.open_input_file(name) as file:
            out.append(pq.read_table(file))
    return out
