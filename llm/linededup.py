"""Fuzzy line deduplication: character-shingle min-max signatures, banding, full-set confirmation and components;
of each component of lines the first occurrence stays.

A line is what stands between line ends, compared without blanks at its ends and with A-Z in lower case. Its set
holds the distinct runs of ``width`` characters (a shorter line is one run). Every line that is not blank takes part,
whatever its length and script; a line shorter than ``width`` can only be equal to another, which its hash tells.

1. Tasks scan the texts in windows of lines, and keep their rows in a file each (``partfiles``). Of equal lines of a
   window only the first occurrence goes on, the others are known to go. Band keys leave as packed blobs (``bands``).
2. Equal lines of all windows meet in one share (a line sends one row a window, however frequent it is), with the band keys of
   that share; again only the first occurrence goes on.
3. Buckets give pairs, full sets confirm them, links become components (``lsh``, ``components``).
4. Only the lines with links are grouped by component; all but the first occurrence of a component go.
5. Decisions are dealt out by the partition the line came from, and its task cuts them out of the rows of the file.

Equal lines are told by 128 bits. In the graph of similar lines a line goes by the first 64 of them; should two
different lines have these in common, the one with the smaller rest stands for them and the other has no links. The first
occurrence is the smallest (doc_id, text hash, line number). Texts of any length are scanned in parts of about a
million characters, a single longer line too.

Defined results: null texts stay null, texts without lines to remove stay as they are; a text can become empty but
its row stays; rows of equal id and text are one document (their equal lines count once); a null id comes
first; a column ``n_chars`` is brought up to date, all other columns are kept; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.bands import BLOBS, Window, blob_batch, share_members, with_pivots
from llm.common import broadcast_if_small, byte_slices, free_name, fresh_dir, roomy, row_key, spread, stored
from llm.hashing import U, mix
from llm.lsh import similar_components
from llm.minmax import band_keys, signatures
from llm.partfiles import PartWriter, read_part

WIDTH, PERCENT, BANDS, ROWS = 8, 80, 14, 4
#: Bytes of a slice of texts (its arrays stay in the cache of a core), characters of a part of a long text, lines of one window.
SLICE = 1 << 17
PART = 1 << 20
WINDOW_LINES = 1 << 16
#: Tables of more (narrow) rows than this are not broadcast.
SMALL_ROWS = 50_000
WHITE_CHARS = " \t\n\v\f\r"
STEPS = np.random.default_rng(20240811).integers(1, 1 << 62, 16, dtype=np.uint64) * U(2) + U(1)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts (A-Z in lower case) and the offsets of each text."""
    texts = texts.fill_null("") if texts.null_count else texts
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    codes = codes + np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint32)
    return codes, np.concatenate([[0], np.cumsum(size)])


def lines_of(codes: np.ndarray, offsets: np.ndarray):
    """Of each line: document, number in it, start and end (without blanks at its ends), number of words."""
    n = len(offsets) - 1
    cut = np.flatnonzero(codes == 10)
    doc_cut = np.searchsorted(offsets[1:], cut, "right")
    # a line begins at the start of each text and behind each line end
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(n), doc_cut]), kind="stable")
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.empty_like(start)
    end[last] = offsets[1:]
    end[~last] = start[1:][~last[:-1]] - 1
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    filled = np.flatnonzero(~white)
    first = np.searchsorted(filled, start)
    beyond = np.searchsorted(filled, end)
    has = beyond > first
    safe = np.append(filled, 0)
    start = np.where(has, safe[np.minimum(first, len(filled))], start)
    end = np.where(has, safe[np.maximum(beyond - 1, 0)] + 1, start)
    opens = ~white
    opens[1:] &= white[:-1]
    opens[start[has]] = True
    words = np.concatenate([[0], np.cumsum(opens)])
    return doc, number, start, end, words[end] - words[start]


class Grams:
    """Hashes of all runs of ``width`` code points, and of whole lines."""

    def __init__(self, codes: np.ndarray, width: int):
        self.width = width
        h = mix(codes.astype(np.uint64) + STEPS[0])
        grams = np.zeros(max(len(codes) - width + 1, 0), np.uint64)
        for k in range(width):
            grams += h[k : k + len(grams)] * STEPS[k + 1]
        self.grams, self.points = mix(grams), h

    def sets(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct hashes of each line."""
        out = []
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            if b - a >= self.width:
                s = np.sort(self.grams[a : b - self.width + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            else:
                out.append(np.array([short_line(self.points[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
        return out


def short_line(points: np.ndarray) -> int:
    h = np.full(1, len(points), np.uint64)
    for k in range(len(points)):
        h = mix(h * U(31) + points[k : k + 1])
    return int(h[0])


#: A line is known by two sums of mixed code points times powers of these (odd) numbers, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, SLICE)
        steps = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        known = np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])
        if size <= 2 * PART:  # no longer ones are kept
            _powers[base] = known
    return known[0][:n], known[1][:n]


def line_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line as two arrays."""
    out = []
    for base in BASES:
        up, down = powers(base, len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * up[:-1], out=sums[1:])
        out.append(ended((sums[end] - sums[start]) * down[start] * U(base), end - start))
    return out[0], out[1]


def ended(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(total + length.astype(np.uint64) * U(0x632BE59BD9B4E019))


def line_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The set of each text that is one line."""
    out: list[np.ndarray] = []
    for a, b in byte_slices(texts):
        if b - a == 1 and len(text := texts[a].as_py() or "") > PART:
            parts = [np.unique(Grams(code_points(pa.array([text[i : i + PART + width - 1]]))[0], width).grams) for i in range(0, len(text) - width + 1, PART)]
            out.append(np.unique(np.concatenate(parts)))
        else:
            codes, offsets = code_points(texts.slice(a, b - a))
            out += Grams(codes, width).sets(offsets[:-1], offsets[1:])
    return out


class LineScan:
    """Hashes and signatures of the lines of texts."""

    def __init__(self, width: int, values: int):
        self.width, self.values = width, values

    def short(self, texts: pa.Array):
        """Of each line that is not blank: text number, line number, two hashes, whether it has a signature; and the
        signatures of the distinct lines that have one (by their first hash)."""
        codes, offsets = code_points(texts)
        doc, number, start, end, words = lines_of(codes, offsets)
        use = np.flatnonzero(words)
        doc, number, start, end = doc[use], number[use], start[use], end[use]
        grams = Grams(codes, self.width)
        line, check = line_hashes(grams.points, start, end)
        at = np.unique(line, return_index=True)[1]
        at = at[end[at] - start[at] >= self.width]
        count = (end[at] - start[at]) - self.width + 1
        place = np.repeat(start[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        table = signatures(grams.grams[place], count, -(-self.values // 2)) if len(at) else np.zeros((0, self.values), np.uint32)
        return doc, number, line, check, line[at], table

    def long(self, text: str):
        """The two hashes and the signature of one very long line."""
        totals, table = [0, 0], None
        for i in range(0, len(text), PART):
            codes, _ = code_points(pa.array([text[i : i + PART + self.width - 1]]))
            grams = Grams(codes, self.width)
            own = min(PART, len(text) - i)
            for k, base in enumerate(BASES):
                total = int((grams.points[:own] * powers(base, own)[0]).sum(dtype=np.uint64))
                totals[k] = (totals[k] + total * pow(base, i + 1, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
            if len(grams.grams):
                part = signatures(grams.grams, np.array([len(grams.grams)]), -(-self.values // 2))
                table = part if table is None else np.where(np.arange(part.shape[1]) % 2, np.maximum(table, part), np.minimum(table, part))
        line, check = (ended(np.array([t], np.uint64), np.array([len(text)])) for t in totals)
        return line, check, table

    def texts(self, texts: pa.Array):
        """All lines of some texts, part by part, as ``short`` gives them."""
        for a, b in byte_slices(texts, SLICE):
            if b - a > 1 or len(text := texts[a].as_py() or "") <= PART:
                found = self.short(texts.slice(a, b - a))
                yield found[0] + a, *found[1:]
                continue
            at, number = 0, 0
            while at <= len(text):
                end = text.rfind("\n", at, at + PART)
                end = end if end >= 0 else text.find("\n", at)
                end = end if end >= 0 and at + PART < len(text) else len(text)
                part = text[at:end]
                if len(part) > PART:  # one line
                    part = part.strip(WHITE_CHARS)
                if len(part) > PART:
                    line, check, table = self.long(part.translate(LOWER_ASCII))
                    yield np.array([a]), np.array([number]), line, check, line, table
                else:
                    found = self.short(pa.array([part]))
                    yield found[0] + a, found[1] + number, *found[2:]
                number += text.count("\n", at, end) + 1
                at = end + 1


LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
LINE = {"line": pa.int64(), "check": pa.int64(), "doc_id": pa.int64(), "tie": pa.int64(), "number": pa.int32(), "part": pa.int32(), "path": pa.string()}
LINE_SCHEMA = "line long, check long, doc_id long, tie long, number int, part int, path string"
SCANNED = f"{BLOBS}, {LINE_SCHEMA}"


def scan_lines(docs: DataFrame, width: int, bands: int, rows: int, shares: int, target: str) -> DataFrame:
    """Blobs of band keys, and of each window rows of kind ``line`` (the first occurrence of each distinct line: line, check,
    doc_id, tie, number, part) and ``gone`` (all further occurrences); and the ``file`` of each part.

    ``docs``: doc_id, tie, text, and then all columns that are to be kept.
    """
    scan = LineScan(width, bands * rows)

    def line_batch(kind, columns, known, share, part):
        n = len(columns[0])
        empty = [pa.nulls(n, pa.binary())] * 3
        arrays = [pa.array([kind] * n), pa.array(share.astype(np.int32)), *empty, *(pa.array(c.view(np.int64)) for c in columns[:2])]
        arrays += [pa.array(columns[2], mask=~known), pa.array(columns[3]), pa.array(columns[4].astype(np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "share", "keys", "nodes", "flags", *LINE])

    def widened(rows):
        batch = blob_batch(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(len(batch), t) for t in LINE.values())], [*batch.schema.names, *LINE])

    def reduced(held, spot):
        line, check, doc, tie, number, known = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((number, tie, doc, known, check, line))
        line, check, doc, tie, number, known = (c[order] for c in (line, check, doc, tie, number, known))
        new = np.append(True, (line[1:] != line[:-1]) | (check[1:] != check[:-1]))
        same = np.append(False, (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (number[1:] == number[:-1]) & (known[1:] == known[:-1]))
        # lines go to a share by their hash, so that equal ones meet; what goes anyway stays spread
        for kind, use, share in (("line", new, (line % U(shares)).astype(np.int32)), ("gone", ~new & ~same, (spot + np.arange(len(line))) % shares)):
            if use.any():
                yield line_batch(kind, [c[use] for c in (line, check, doc, tie, number)], known[use], share[use], spot)

    def work(batches):
        spot = TaskContext.get().partitionId()
        window, held, lines = Window(shares, spot % shares), [], 0
        writer = PartWriter(target, spot)
        for batch in batches:
            for a, b in byte_slices(batch.column(2), 1 << 21):
                writer.write(batch.slice(a, b - a))
            ids, ties = batch.column(0), batch.column(1).to_numpy()
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for doc, number, line, check, signed, table in scan.texts(batch.column(2)):
                held.append((line, check, ids[doc], ties[doc], number, known[doc]))
                lines += len(line)
                if len(signed):
                    blobs = window.add(signed.view(np.int64), band_keys(table, rows)[:, :bands])
                    if blobs:
                        yield widened(blobs)
                if lines >= WINDOW_LINES:
                    yield from reduced(held, spot)
                    held, lines = [], 0
        if lines:
            yield from reduced(held, spot)
        blobs = window.flush()
        if blobs:
            yield widened(blobs)
        path = writer.close()
        if path:
            none = [pa.nulls(1, pa.binary())] * 3 + [pa.nulls(1, t) for t in list(LINE.values())[:-2]]
            yield pa.RecordBatch.from_arrays([pa.array(["file"]), pa.array([spot % shares], pa.int32()), *none, pa.array([spot], pa.int32()), pa.array([path])], ["kind", "share", "keys", "nodes", "flags", *LINE])

    return docs.mapInArrow(roomy(work), SCANNED)


SETTLED = f"kind string, key long, node long, pivot long, {LINE_SCHEMA}"
SETTLED_NAMES = [x.split()[0] for x in SETTLED.split(", ")]


def settle_shares(batches):
    """Of equal lines the first occurrence stays a ``line`` (in each part that has its document), all others are ``gone``; rows of
    other kinds pass as they are; blobs become members of buckets."""
    blobs, held = [], []
    for batch in batches:
        own = pc.is_in(batch.column(0), pa.array(["keys", "local"]))
        line = pc.equal(batch.column(0), "line")
        others = batch.filter(pc.invert(pc.or_(own, line)))
        if len(others):
            none = [pa.nulls(len(others), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([others.column(0), *none, *(others.column(c) for c in LINE)], SETTLED_NAMES)
        lines = batch.filter(line)
        if len(lines):
            doc = lines.column("doc_id")
            held.append((*(lines.column(c).to_numpy() for c in ("line", "check")), np.asarray(doc.is_valid()), doc.fill_null(0).to_numpy(), *(lines.column(c).to_numpy() for c in ("tie", "number", "part"))))
        if pc.any(own).as_py():
            blobs.append(batch.filter(own))
    if held:
        yield from first_lines([np.concatenate(c) for c in zip(*held, strict=True)])
    held.clear()
    for found in share_members(iter(blobs)):
        n = len(found)
        none = [pa.nulls(n, t) for t in LINE.values()]
        yield pa.RecordBatch.from_arrays([pa.array(["member"] * n), *found.columns, *none], SETTLED_NAMES)


def first_lines(columns: list[np.ndarray]):
    """``columns``: line, check, whether there is a doc_id, doc_id, tie, number, part of all rows of some lines."""
    order = np.lexsort(columns[::-1])
    line, check, known, doc, tie, number, part = (c[order] for c in columns)
    start = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (check[1:] != check[:-1])))
    lead = np.repeat(start, np.diff(start, append=len(line)))
    stays = np.ones(len(line), bool)
    for c in (known, doc, tie, number):
        stays &= c == c[lead]
    for a in range(0, len(line), 100_000):
        at = slice(a, a + 100_000)
        n = len(line[at])
        own = [pa.array(line[at]), pa.array(check[at]), pa.array(doc[at], mask=~known[at]), *(pa.array(c[at]) for c in (tie, number, part))]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(stays[at], "line", "gone")), *[pa.nulls(n, pa.int64())] * 3, *own, pa.nulls(n, pa.string())], SETTLED_NAMES)


def by_part(rows: DataFrame, parts: int, work_on, schema) -> DataFrame:
    """``rows``: part, path (in one row of each part) and three columns of what is asked or decided; a task takes whole parts."""

    def work(batches):
        held: dict[int, list] = {}
        paths: dict[int, str] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            own = np.asarray(batch.column(1).is_valid())
            for i in np.flatnonzero(own).tolist():
                paths[int(part[i])] = batch.column(1)[i].as_py()
            for p in np.unique(part[~own]).tolist():
                held.setdefault(p, []).append(batch.filter(pa.array((part == p) & ~own)))
        for p, path in paths.items():
            yield from work_on(read_part(path), pa.Table.from_batches(held.pop(p)) if p in held else None)

    return rows.repartition(parts, "part").mapInArrow(roomy(work), schema)


def numbers_by_row(asked: pa.Table) -> dict:
    """(doc_id, tie) -> places in ``asked`` (columns doc_id, tie from the third on)."""
    out: dict = {}
    for i, key in enumerate(zip(asked.column(2).to_pylist(), asked.column(3).to_pylist(), strict=True)):
        out.setdefault(key, []).append(i)
    return out


def line_texts(files: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """``asked`` (part, doc_id, tie, number of a line, and further columns): the further columns and the ``text`` of the line."""
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    place = ("part", "doc_id", "tie", "number")
    extra = [f for f in asked.schema.fields if f.name not in place]
    names = [f.name for f in extra]
    asks = asked.select("part", none("string", "path"), "doc_id", "tie", F.col("number").cast("long").alias("number"), *names)
    places = files.select("part", "path", *[none("long", c) for c in ("doc_id", "tie", "number")], *[none(f.dataType, f.name) for f in extra])

    def texts_of(batches, asked):
        if asked is None:
            return
        places = numbers_by_row(asked)
        number, own = asked.column(4).to_pylist(), asked.select(names)

        def found(at, texts):
            taken = own.take(pa.array(at)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in taken.columns), pa.array(texts, pa.string())], [*names, "text"])

        for batch in batches:
            at, texts, size = [], [], 0
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key in places:
                    lines = batch.column(2)[row].as_py().split("\n")
                    for i in places.pop(key):
                        at.append(i)
                        texts.append(lines[number[i]].strip(WHITE_CHARS))
                        size += len(texts[-1])
                        if size >= PART:  # a line may be asked for many times
                            yield found(at, texts)
                            at, texts, size = [], [], 0
            if at:
                yield found(at, texts)

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in extra), T.StructField("text", T.StringType())])
    return by_part(asks.unionByName(places), parts, texts_of, schema)


def duplicate_lines(settled: DataFrame, width: int, percent: int, values: int, parts: int) -> DataFrame:
    """(part, doc_id, tie, number) of each line that goes."""
    files = settled.filter("kind = 'file'").select("part", "path")
    members = with_pivots(settled.filter("kind = 'member'").select("key", "node", "pivot"))
    lines = settled.filter("kind = 'line'").select("line", "check", "doc_id", "tie", "number", "part")
    gone = settled.filter("kind = 'gone'").select("part", "doc_id", "tie", "number")
    linked = similar_lines(files, lines, members, width, percent, values, parts)
    if linked is None:
        return gone
    here = F.struct("doc_id", "tie", "number")
    first = linked.groupBy("component").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first < last").select("component", "first")
    # stored, so that a component with very many rows can be split by the join
    again = linked.join(broadcast_if_small(stored(first), SMALL_ROWS), "component")
    return gone.unionByName(again.filter(~here.eqNullSafe(F.col("first"))).select("part", "doc_id", "tie", "number"))


def similar_lines(files: DataFrame, lines: DataFrame, members: DataFrame, width: int, percent: int, values: int, parts: int) -> DataFrame | None:
    """(component, doc_id, tie, number, part) of the lines that have a similar line; nothing if no two lines share a bucket."""
    nodes = stored(members.select("node").union(members.select("pivot")).distinct())
    if nodes.isEmpty():
        return None
    found = stored(lines.withColumnRenamed("line", "node").join(broadcast_if_small(nodes, SMALL_ROWS), "node", "left_semi"))
    one = stored(found.groupBy("node").agg(F.min(F.struct("check", "doc_id", "tie", "number", "part")).alias("at")).select("node", "at.*"))
    place = one.select(F.col("node").alias("ask"), "part", "doc_id", "tie", "number")
    # the lines to look up are joined as ids, and their texts are read where they stand
    links = similar_components(members, lambda asks: line_texts(files, asks.join(place, "ask"), parts), lambda t: line_sets(t, width), (percent, 100), values)
    # of two lines with one first half of the hash only that with the smaller rest has links
    labels = links.join(one.select("node", "check"), "node")
    return stored(found.join(labels, ["node", "check"]).select("component", "doc_id", "tie", "number", "part"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts, plus ``n_lines_removed``; all rows and columns stay."""
    kept = [f for f in docs.schema.fields if f.name != "n_lines_removed"]
    keyed = spread(docs.select(F.col(id_col).cast("long").alias(free_name(docs, "this_doc")), row_key(text_col).alias(free_name(docs, "this_tie")), F.col(text_col).alias(free_name(docs, "this_text")), *[f"`{f.name}`" for f in kept if f.name != text_col]))
    parts = keyed.rdd.getNumPartitions()
    shares = max(8, 2 * parts)
    target = fresh_dir(docs.sparkSession, "lines")
    settled = stored(scan_lines(keyed, width, bands, rows, shares, target).repartition(shares, "share").mapInArrow(roomy(settle_shares), SETTLED))
    gone = duplicate_lines(settled, width, percent, bands * rows, parts)
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    rows_of = gone.select("part", none("string", "path"), "doc_id", "tie", F.col("number").cast("long").alias("number"))
    rows_of = rows_of.unionByName(settled.filter("kind = 'file'").select("part", "path", *[none("long", c) for c in ("doc_id", "tie", "number")]))
    schema = T.StructType([*kept, T.StructField("n_lines_removed", T.LongType())])
    others = [f.name for f in kept if f.name != text_col]
    chars = "n_chars" if "n_chars" in others else None

    def cut(batches, decided):
        places = {} if decided is None else numbers_by_row(decided)
        number = [] if decided is None else decided.column(4).to_pylist()
        for batch in batches:
            text, removed = batch.column(2).to_pylist() if places else None, np.zeros(len(batch), np.int64)
            size = {}
            if places:
                for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if key in places:
                        drop = {number[i] for i in places[key]}
                        text[row] = "\n".join([line for k, line in enumerate(text[row].split("\n")) if k not in drop])
                        removed[row], size[row] = len(drop), len(text[row])
            columns = dict(zip(others, batch.columns[3:], strict=True))
            columns[text_col] = pa.array(text, batch.column(2).type) if size else batch.column(2)
            if chars and size:
                counts = columns[chars].to_pylist()
                for row, n in size.items():
                    counts[row] = n
                columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays([*(columns[f.name] for f in kept), pa.array(removed)], schema.names)

    return by_part(rows_of, parts, cut, schema)
