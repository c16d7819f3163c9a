"""JSON arrays as splittable files: a reader in which every task takes a byte range, and a writer without a single task.

A file that holds one JSON array has no line to split at, but each closing brace is a place where Spark's text reader can.
What a range means depends on what stands before it: whether a string is open, and how deep the brackets are. So each
range is read for both cases first (open string or not) and summed up as: string open at the end, change of depth,
commas by depth. A row per range goes to the driver, which chains them (``chain``). In the second
pass every range knows its state and the number of its first element, and cuts its text at the commas of depth 1. An
element that lies across ranges is put together from its parts.
"""

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark.session import cut_lineage

SUMMARY = "file string, block long, opened boolean, ends_open boolean, depth int, commas array<struct<depth:int,n:long>>, begins string, only string"
PIECES = "file string, place long, block long, whole boolean, text string"
MANIFEST = "part int, path string"
STEP = np.zeros(256, np.int64)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
MARK = STEP != 0
MARK[ord(",")] = True


def ranges_of(spark: SparkSession, path) -> DataFrame:
    """file, block (start of the range), value: what stands between closing braces, in order within a range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Brackets and commas: their places, the number of quotes before each, and the number of quotes in all.

    A quote behind an odd number of backslashes is a character of a string.
    """
    quotes = np.flatnonzero(raw == ord('"'))
    slash = raw == ord("\\")
    if slash.any():
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
        before = np.where(quotes > 0, last_other[quotes - 1], quotes - 1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    places = np.flatnonzero(MARK[raw])
    return places, np.searchsorted(quotes, places), len(quotes)


def stretches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[str, int, bool, bytes]]:
    """(file, block, whether the range begins here, bytes): the text of each range in stretches that end before a brace."""
    last = None
    for batch in batches:
        held: list[bytes] = []
        size = 0
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != last:
                if held:
                    yield *last, begins, b"".join(held)
                held, size, begins, last = [], 0, True, (file, block)
                # the brace that ends the range before belongs to this one
                held.append(b"}" if block else b"")
            else:
                if size >= most:
                    yield *last, begins, b"".join(held)
                    held, size, begins = [], 0, False
                held.append(b"}")
            text = value.encode()
            held.append(text)
            size += len(text) + 1
        if held:
            yield *last, begins, b"".join(held)
            begins = False


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per range, one for each case of its start."""
    now, states, head, only = None, [], "", None

    def rows():
        commas = [[{"depth": d, "n": n} for d, n in sorted(s["commas"].items())] for s in states]
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * 2), pa.array([now[1]] * 2), pa.array([False, True]), pa.array([s["open"] for s in states]), pa.array([s["depth"] for s in states], pa.int32()),
             pa.array(commas, pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64())]))), pa.array([head] * 2), pa.array([only] * 2, pa.string())],
            [x.split()[0] for x in SUMMARY.split(", ")],
        )

    for file, block, begins, text in stretches(batches):
        if begins:
            if now is not None:
                yield rows()
            now, states = (file, block), [{"open": o, "depth": 0, "commas": {}} for o in (False, True)]
            head = text.lstrip()[:1].decode(errors="replace")
            only = text.decode(errors="replace") if len(text) < 1000 else None
        else:
            only = None
        raw = np.frombuffer(text, np.uint8)
        places, before, quotes = marks(raw)
        for state in states:
            outside = (before + state["open"]) % 2 == 0
            signs = raw[places[outside]]
            depth = state["depth"] + np.cumsum(STEP[signs])
            for d, n in zip(*np.unique(depth[signs == ord(",")], return_counts=True), strict=True):
                state["commas"][int(d)] = state["commas"].get(int(d), 0) + int(n)
            state["depth"] = int(depth[-1]) if len(depth) else state["depth"]
            state["open"] = bool((state["open"] + quotes) % 2)
    if now is not None:
        yield rows()


def chain(ranges: list, order: dict[str, tuple[str, int]]) -> tuple[dict, dict[str, int]]:
    """Per range (string open, depth, elements before), and per array its number of elements.

    ``order``: file -> (array it is part of, place in it).
    """
    cases = {(r["file"], r["block"], r["opened"]): r for r in ranges}
    starts, sizes, state, heads, texts = {}, {}, {}, {}, {}
    for file, block in sorted({k[:2] for k in cases}, key=lambda k: (*order[k[0]], k[1])):
        name = order[file][0]
        opened, depth, count = state.get(name, (False, 0, 0))
        row = cases[file, block, opened]
        heads.setdefault(name, row["begins"])
        texts.setdefault(name, []).append(row["only"])
        starts[file, block] = (opened, depth, count)
        count += sum(c["n"] for c in row["commas"] if c["depth"] == 1 - depth)
        state[name] = (row["ends_open"], depth + row["depth"], count)
    for name, (opened, depth, count) in state.items():
        if heads[name] != "[" or opened or depth:
            raise ValueError(f"not a whole JSON array: {name}")
        parts = texts[name]
        empty = not count and None not in parts and re.fullmatch(r"\s*\[\s*\]\s*", "".join(parts))
        sizes[name] = 0 if empty else count + 1
    return starts, sizes


def elements(starts: dict):
    """A task's part of the second pass: each element, or what the range has of it, with its place in the array."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        now, opened, depth, place, whole, held = None, False, 0, 0, False, []

        def batch():
            columns = zip(*out, strict=True)
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for file, block, begins, text in stretches(batches):
            if begins:
                if held:
                    out.append((*now, False, b"".join(held)))
                now, held, whole = (file, place, block), [], False
                opened, depth, place = starts[file, block]
                now = (file, place, block)
            raw = np.frombuffer(text, np.uint8)
            places, before, quotes = marks(raw)
            outside = (before + opened) % 2 == 0
            at = places[outside]
            signs = raw[at]
            after = depth + np.cumsum(STEP[signs])
            # the bracket that opens the array, the commas between elements, the bracket that closes it
            border = ((after == 1) & (signs == ord(","))) | ((after == 1) & (signs == ord("["))) | ((after == 0) & (signs == ord("]")))
            inside, begin = depth > 0, 0
            for p, sign, level in zip(at[border].tolist(), signs[border].tolist(), after[border].tolist(), strict=True):
                if inside:
                    held.append(text[begin:p])
                    out.append((file, place, block, whole, b"".join(held)))
                    size += len(out[-1][-1])
                    held = []
                    place += 1
                begin, whole, inside = p + 1, True, level > 0
            if inside:
                held.append(text[begin:])
            now = (file, place, block)
            depth = int(after[-1]) if len(after) else depth
            opened = bool((opened + quotes) % 2)
            if size >= 1 << 22 or len(out) >= 10_000:
                yield batch()
                out, size = [], 0
        if held:
            out.append((*now, False, b"".join(held)))
        if out:
            yield batch()

    return cut


def array_elements(spark: SparkSession, path, order: dict[str, tuple[str, int]] | None = None, id_col: str = "pos") -> DataFrame:
    """``pos, entry``: the elements of all arrays as JSON text (strings without quotes), numbered over all files by path."""
    ranges = ranges_of(spark, path)
    found = ranges.mapInArrow(summaries, SUMMARY).collect()
    order = order or {r["file"]: (r["file"], 0) for r in found}
    starts, sizes = chain(found, order)
    first, total = {}, 0
    for name in sorted(sizes):
        first[name], total = total, total + sizes[name]
    shift = spark.createDataFrame([(f, first[n], sizes[n]) for f, (n, _) in order.items() if n in sizes] or [("", 0, 0)], "file string, shift long, size long")
    pieces = ranges.mapInArrow(elements(starts), PIECES)
    # one row per file of a listing that the driver holds anyway
    placed = pieces.join(F.broadcast(shift), "file").filter("place < size").withColumn(id_col, F.col("shift") + F.col("place"))
    parts = placed.filter("not whole").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("file", "block", "text"))).alias("parts"))
    # parts of one array lie in files by name, so (file, block) is their order
    texts = placed.filter("whole").select(id_col, "text").unionByName(parts.select(id_col, F.array_join("parts.text", "").alias("text")))
    entry = F.get(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>"), F.lit(0))
    return texts.select(id_col, entry.alias("entry"))


def write_json_array(df: DataFrame, path: str, order: Sequence[str], entry: str = "entry") -> None:
    """One JSON array, in parts that are each written by a task: joined in order of their names they are the array.

    ``entry`` holds the elements as JSON text. Separators follow from the row counts of the partitions, which only need
    a row per partition on the driver. The manifest is written last, so a broken write leaves the array before it in place.
    """
    spark = df.sparkSession
    rows = df.select(F.col(entry).alias("__entry"), *[c for c in order])
    ordered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__entry"))
    task, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["count"] for r in ordered.groupBy(task.alias("p")).count().collect()}
    if counts:
        low, high = min(counts), max(counts)
        first = (task == low) & (row == 0)
        last = (task == high) & (row == counts[high] - 1)
        text = F.concat(F.when(first, "[").otherwise(""), "__entry", F.when(last, "]").otherwise(","))
        lines = ordered.select(text.alias("value"))
    else:
        lines = spark.createDataFrame([("[]",)], "value string")
    parts = f"{path}/parts-{uuid.uuid4()}"
    lines.write.text(parts)
    names = sorted(spark.read.text(parts).inputFiles())
    spark.createDataFrame(list(enumerate(names)), MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def array_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of a written array in order."""
    return [r["path"] for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("part").collect()]


def read_written_array(spark: SparkSession, path: str, id_col: str = "pos") -> DataFrame:
    """``pos, entry`` of an array of ``write_json_array``."""
    parts = array_parts(spark, path)
    listed = {r["file"] for r in spark.read.text(parts).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    by_name = {f.rsplit("/", 1)[1]: f for f in listed}
    order = {by_name[p.rsplit("/", 1)[1]]: (path, i) for i, p in enumerate(parts) if p.rsplit("/", 1)[1] in by_name}
    return array_elements(spark, parts, order, id_col)
