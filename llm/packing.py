"""Best-fit packing by rounds: tasks pack locally, nearly full bins are emitted, underfull bins go on as items.

Round 0 deals the (stored) pieces into groups of about ``local_items`` and packs each best-fit decreasing. Bins with at most ``slack`` free places are
final. The others become items (their length is what they hold) of the next round, in which hashed groups
of at most ``group_items`` items are packed again; rounds end when one group was packed or a round
saves less than one bin in 200. A task holds lengths and row numbers only, of one group. Pieces are stored before
they are packed, so no task runs the encoder and the packing side by side. Every round is written before it is read, so a lost executor repeats tasks, not rounds.

Defined results: a null text is the empty text (it still has its end id); repeated rows are packed each; an
empty table gives no rows; a text of any length is cut into pieces of the capacity, the first may be shorter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import byte_slices, roomy, spread, stored
from llm.tokens import worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def work(batches):
        encoder, end = worker_encoder(tokenizer), np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for a, b in byte_slices(batch.column(1), 1 << 20):
                flat, counts = encoder.ids(batch.column(1).slice(a, b - a))
                ends, row, start, length, crc = np.cumsum(counts), [], [], [], []
                for i, (n, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    raw = memoryview(np.concatenate([flat[e - n : e], end]).astype("<u4").tobytes())
                    n += len(end)
                    at = 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        at += size
                row = np.array(row, np.int64)
                piece = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(roomy(work, encoders=False), PIECES)


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and what each bin holds."""
    bin_of, offset, held = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit f is set while a bin with f free places is open
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        fits = rooms >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            k = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            k, free = len(held), capacity
            held.append(0)
        bin_of[i], offset[i] = k, held[k]
        held[k] += n
        free -= n
        if free:
            room[free].append(k)
            rooms |= 1 << free
    return bin_of, offset, np.array(held, np.int64)


def pack_partitions(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (with a column ``length``) plus bin, offset and what the bin holds; each partition on its own."""
    names = items.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)

    def work(batches):
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            bin_of, offset, held = best_fit(table.column("length").to_numpy(), capacity)
            own = (TaskContext.get().partitionId() << 34) + bin_of
            for name, values in (("bin", own), ("offset", offset), ("held", held[bin_of])):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    return items.select(*names).mapInArrow(roomy(work, encoders=False), f"{schema}, bin long, offset long, held long")


def pack(pieces: DataFrame, capacity: int = 1024, slack: int | None = None, group_items: int = 200_000, most_rounds: int = 12, local_items: int = 50_000) -> DataFrame:
    """``pieces`` (any columns, with ``length`` of 1 to ``capacity``) plus sequence_id and offset."""
    slack = capacity // 256 if slack is None else slack
    pieces = stored(pieces)
    placed = stored(pack_partitions(pieces.repartition(max(1, -(-pieces.count() // local_items))), capacity))
    maps, level = [], placed
    for number in range(1, most_rounds):
        open_bins = level.filter(F.col("held") < capacity - slack).groupBy("bin").agg(F.first("held").alias("length")).withColumnRenamed("bin", "item")
        count = open_bins.count()
        if count < 2:
            break
        groups = -(-count // group_items)
        level = stored(pack_partitions(open_bins.repartition(groups, F.xxhash64("item", F.lit(number))), capacity))
        maps.append(level.select(F.col("item"), F.col("bin").alias("to_bin"), F.col("offset").alias("shift")))
        after = level.select("bin").distinct().count()
        if groups == 1 or after > count * 0.995:
            break
    out = placed.drop("held").withColumn("sequence_id", F.col("bin") * 16)
    for number, step in enumerate(maps, 1):
        # only what was placed in the round before can go on
        match = F.col("sequence_id") == F.col("item") * 16 + (number - 1)
        out = out.join(step, match, "left").withColumns(
            {"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "sequence_id": F.coalesce(F.col("to_bin") * 16 + number, "sequence_id")}
        ).drop("item", "to_bin", "shift")
    return out.drop("bin")
