"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File format (little endian). Frames come first; each is a zstandard frame of its own that decompresses to
    u32 number of documents n, u8 bytes per id (2 or 4), n x i64 doc_id, n x u32 ids of the document, all ids
Then a skippable frame (magic 0x184D2A50) with one (i64 first doc_id, u32 documents, u64 ids) per frame, and last
the seek table of the seekable format (skippable frame 0x184D2A5E: per frame u32 compressed size, u32 size,
u32 checksum = low half of XXH64 of the content; then u32 number of frames, u8 0x80, magic 0x8F92EAB1).
A reader takes the last bytes of a file, finds the frames it needs and decompresses only those.

Documents are dealt over files by ranges of (doc_id, text hash) and stand in ascending doc_id order, files in
order of their number. A task writes under a name of its own attempt, and only the names in the manifest
(which Spark commits) count, so repeated or lost attempts leave no trace in the results.

Defined results: a null text is the empty text; a null doc_id is stored as -2^63 and read back as null, and
comes first; repeated rows are stored each; an empty table gives no file. Extra columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import byte_slices, fresh_dir, roomy, row_key, stored
from llm.tokens import worker_encoder

SEEK_MAGIC, SEEK_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
NO_ID = -(1 << 63)
FRAME_IDS = 1 << 18
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_frames long, bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_store(uri: str):
    """A file system of pyarrow and the path in it, for a folder that Spark names."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents in the order they come; ``close`` writes the index and the seek table."""

    def __init__(self, out, wide: bool, level: int = 3):
        self.out, self.width = out, 4 if wide else 2
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.ids: list[int] = []
        self.runs: list[np.ndarray] = []
        self.waiting = 0
        self.seek, self.index = [], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.runs.append(ids)
        self.waiting += len(ids)
        if self.waiting >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.ids:
            sizes = np.array([len(r) for r in self.runs], "<u4")
            flat = np.concatenate(self.runs).astype("<u4" if self.width == 4 else "<u2")
            content = struct.pack("<IB", len(self.ids), self.width) + np.array(self.ids, "<i8").tobytes() + sizes.tobytes() + flat.tobytes()
            frame = self.press.compress(content)
            self.out.write(frame)
            self.seek.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.index.append(struct.pack("<qIQ", self.ids[0], len(self.ids), len(flat)))
        self.ids, self.runs, self.waiting = [], [], 0

    def close(self) -> int:
        self.flush()
        for magic, body in ((INDEX_MAGIC, b"".join(self.index)), (SEEK_MAGIC, b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_END))):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        return len(self.seek)


class FrameReader:
    """Reads the seek table and the index of a file, then single frames on demand."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        entry, own = 12, 20
        file.seek(size - 9 - count * entry - 8 - count * own - 8)
        tail = file.read(count * (entry + own) + 16)
        self.index = [struct.unpack_from("<qIQ", tail, 8 + own * i) for i in range(count)]
        self.seek = [struct.unpack_from("<III", tail, 16 + own * count + entry * i) for i in range(count)]
        self.at = np.concatenate([[0], np.cumsum([s[0] for s in self.seek])]).astype(int)
        self.press = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, ids per document and all ids of one frame; a damaged frame fails."""
        self.file.seek(int(self.at[i]))
        content = self.press.decompress(self.file.read(self.seek[i][0]), max_output_size=self.seek[i][1])
        if len(content) != self.seek[i][1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.seek[i][2]:
            raise ValueError(f"frame {i} is damaged")
        n, width = struct.unpack_from("<IB", content)
        docs = np.frombuffer(content, "<i8", n, 5)
        sizes = np.frombuffer(content, "<u4", n, 5 + 8 * n)
        return docs, sizes.astype(np.int64), np.frombuffer(content, "<u4" if width == 4 else "<u2", -1, 5 + 12 * n)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The ids of the wanted documents; only frames that can hold one of them are decompressed."""
        first = np.array([x[0] for x in self.index], np.int64)
        ask = np.array(sorted(wanted), np.int64)
        for i in range(len(first)):
            last = first[i + 1] if i + 1 < len(first) else np.iinfo(np.int64).max
            if np.searchsorted(ask, last, "right") > np.searchsorted(ask, first[i]):
                docs, sizes, ids = self.frame(i)
                end = np.cumsum(sizes)
                for k in np.flatnonzero(np.isin(docs, ask)):
                    yield int(docs[k]), ids[end[k] - sizes[k] : end[k]]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Tokenise whole texts and write the files; gives the stored manifest, one row per file."""
    spark = docs.sparkSession
    target = fresh_dir(spark, "tokens")
    parts = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", row_key("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def work(batches):
        encoder, end = worker_encoder(tokenizer), [] if end_id is None else [end_id]
        wide = max(encoder.tokenizer.get_vocab_size(), *end, 0) > 0xFFFF
        store, folder = open_store(target)
        part = TaskContext.get().partitionId()
        path, out = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst", None
        n_docs = n_tokens = 0
        for batch in batches:
            ids_of = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for a, b in byte_slices(batch.column(1), 1 << 20):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    writer = FrameWriter(out, wide)
                flat, counts = encoder.ids(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                for i in range(a, b):
                    ids = np.append(flat[ends[i - a] - counts[i - a] : ends[i - a]], np.array(end, np.uint32))
                    writer.add(int(ids_of[i]), ids)
                    n_tokens += len(ids)
                n_docs += b - a
        if out is not None:
            frames = writer.close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{target}/{path.rsplit('/', 1)[1]}"], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_frames": [frames], "bytes": [size]})

    return stored(rows.mapInArrow(roomy(work, encoders=False), MANIFEST))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: its place among all ids, its number of ids and their checksum.

    The manifest has one row per file (tens of megabytes each), so its running sum is made on the driver.
    """
    files = manifest.orderBy("part").select("path", "n_tokens").collect()
    begin, todo = 0, []
    for f in files:
        todo.append((f["path"], begin))
        begin += f["n_tokens"]
    jobs = spark.createDataFrame(todo, "path string, begin long").repartition(max(1, len(todo)))

    def work(batches):
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder, _, name = path.rpartition("/")
                store, folder = open_store(folder)
                with store.open_input_file(f"{folder}/{name}") as file:
                    reader = FrameReader(file)
                    for i in range(len(reader.index)):
                        docs, sizes, ids = reader.frame(i)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        ends = np.cumsum(sizes)
                        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(at + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])

    return jobs.mapInArrow(roomy(work, encoders=False), TOKENS)


def fetch_tokens(spark: SparkSession, manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token ids of the wanted documents: (doc_id, ids); only frames that hold one of them are decompressed.

    ``wanted`` must be a bounded list of requests (it is collected, at most 100,000).
    """
    ask = [r[0] for r in wanted.select(F.col(id_col).cast("long")).distinct().limit(100_001).collect()]
    if len(ask) > 100_000:
        raise ValueError("more than 100,000 documents asked for: join with read_tokens instead")
    numbers = {NO_ID if x is None else x for x in ask}
    jobs = manifest.select("path").repartition(max(1, manifest.count()))

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, folder = open_store(folder)
                with store.open_input_file(f"{folder}/{name}") as file:
                    for doc, ids in FrameReader(file).documents(numbers):
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None if doc == NO_ID else doc], pa.int64()), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return jobs.mapInArrow(roomy(work, encoders=False), "doc_id long, ids array<long>")
