"""Repeated byte strings across documents, by a logarithmic family of suffix arrays.

Every string of ``length`` bytes (a window) has an anchor: the run of ``gram`` bytes inside it with the smallest hash,
the leftmost of equals. Equal windows have equal anchors at equal places, so only suffixes that start at anchors are
indexed, about one byte in sixteen. Neighbouring windows with one anchor form a segment: the bytes from the anchor on, and
those before it. Hashes only choose anchors and deal them out; equality is always that of bytes.

1. Each task keeps its texts in a file (``partfiles``) and sends a few bits of each distinct anchor run. A run that one
   document alone has is told back as such, and goes no further.
2. The segments of the other runs are dealt out by run. Of equal segments of a batch of texts only that of the smallest document leaves.
3. Each share keeps a family of suffix arrays: a batch of segments is sorted by its bytes (behind the anchor, then before it,
   backwards), merge-scanned against every level, where an equal segment of a larger document loses all its
   windows, and levels of like size merge, so there are about log(batches) levels. What is left is one suffix array with the common
   prefixes of neighbours, forwards and backwards: windows with equal classes in both are equal, and larger documents lose them.
4. Decisions go back to the part of the documents they came from, and the bytes are removed.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; documents
of equal id take nothing from each other, and lose the same wherever they stand; a null id takes and loses nothing; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bands import pack_keys, unpack_keys
from llm.common import byte_slices, fresh_dir, roomy, spread, stored, text_bytes
from llm.hashing import Prefix, U, mix
from llm.partfiles import PartWriter, read_part
from llm.tokens import ranges

LENGTH, GRAM = 50, 20
BATCH_BYTES = 2 << 20
ROWS = "kind string, part int, batch int, share int, path string, payload binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept_sha256 string"
DECISION = np.dtype([("r", "<i8"), ("m", "<u8")])


class Anchors:
    """The segments of some texts: document number, first and last window start, place and hash of the anchor."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.raw, self.offsets, self.length = raw, offsets, length
        self.prefix = Prefix(raw)
        sums, down = self.prefix.sums, self.prefix.down
        n = len(raw) - gram + 1
        size = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = ranges(offsets[:-1], size)
        if not len(starts):
            self.doc = self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        grams = mix((sums[gram:] - sums[:-gram]) * down[:n])
        # the upper half orders by hash, the lower half by place
        key = (grams & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        wide, reach = length - gram + 1, 1
        while 2 * reach <= wide:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if wide > reach:
            key = np.minimum(key[: reach - wide], key[wide - reach :])
        anchor = (key[starts] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
        at = np.flatnonzero(new)
        self.first = starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1]
        self.anchor = anchor[at]
        self.doc = np.searchsorted(offsets, self.first, "right") - 1
        self.h = grams[self.anchor]

    def segments(self, chosen: np.ndarray, gram: int) -> np.ndarray:
        """One row of bytes per chosen segment: ``length`` bytes from the anchor on, the bytes before it backwards, how many
        of the latter and of the former there are (zeros fill the rest). The last byte is never zero."""
        length = self.length
        reach = length - gram
        first, last, anchor = self.first[chosen], self.last[chosen] + length, self.anchor[chosen]
        out = np.zeros((len(chosen), length + reach + 2), np.uint8)
        for k in range(length):
            there = anchor + k < last
            out[there, k] = self.raw[anchor[there] + k]
        for k in range(reach):
            there = anchor - 1 - k >= first
            out[there, length + k] = self.raw[anchor[there] - 1 - k]
        out[:, -2] = anchor - first
        out[:, -1] = last - anchor
        return out


def text_order(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that compare byte by byte."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{rows.shape[1]}")


def batch_winners(key: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (key, d): the places, which of them is the first of its key, and for each the number of its key."""
    order = np.lexsort((d, key)) if len(key) else np.zeros(0, np.int64)
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    return order, new, np.cumsum(new) - 1


class Level:
    """A suffix array: segments in the order of their bytes, each once, with its smallest document, part and place in the part."""

    def __init__(self, key, d, p, r):
        self.columns = [key, d, p, r]

    @classmethod
    def of(cls, key, d, p, r):
        """The sorted level of a batch; the same segment of the same document in further parts; and the entries that lose."""
        order = np.lexsort((p, d, key))
        key, d, p, r = key[order], d[order], p[order], r[order]
        new = np.append(True, key[1:] != key[:-1])
        owner = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        further, lost = ~new & (d == owner), d > owner
        columns = (key, d, p, r)
        return cls(*(c[new] for c in columns)), [c[further] for c in columns], [c[lost] for c in columns]

    def __len__(self):
        return len(self.columns[0])

    def merge(self, other: Level) -> Level:
        """Two levels without a common key; a stable sort of two sorted runs is a merge."""
        order = np.argsort(np.concatenate([self.columns[0], other.columns[0]]), kind="stable")
        return Level(*(np.concatenate([a, b])[order] for a, b in zip(self.columns, other.columns, strict=True)))


class Family:
    """Levels of suffix arrays, each at least twice as large as the next; a segment stands in one level only.

    A document id can come from several parts. The level holds one of them; the entries of the others wait until all
    batches are there.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM, batch_entries: int = 65_536):
        self.length, self.reach = length, length - gram
        self.levels: list[Level] = []
        self.lost: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple] = []
        self.held = 0
        self.further: list[list] = []
        self.batch_entries = batch_entries

    def add(self, rows: np.ndarray, d: np.ndarray, p: np.ndarray, r: np.ndarray) -> None:
        self.waiting.append((text_order(rows), d, p, r))
        self.held += len(d)
        if self.held >= self.batch_entries:
            self.flush()

    def lose(self, _, __, p, r) -> None:
        if len(p):
            self.lost.append((p, r))

    def flush(self) -> None:
        """Merge-scan the new batch against every level, then merge levels of like size."""
        if not self.held:
            return
        batch, further, lost = Level.of(*(np.concatenate(c) for c in zip(*self.waiting, strict=True)))
        self.waiting, self.held = [], 0
        if len(further[0]):
            self.further.append(further)
        self.lose(*lost)
        for level in self.levels:
            key = level.columns[0]
            at = np.searchsorted(key, batch.columns[0])
            at[at == len(key)] = 0
            same = key[at] == batch.columns[0]
            if same.any():
                at = at[same]
                old, new = [c[at] for c in level.columns], [c[same] for c in batch.columns]
                later, earlier, equal = new[1] > old[1], new[1] < old[1], new[1] == old[1]
                self.lose(*(c[later] for c in new))
                self.lose(*(c[earlier] for c in old))
                if equal.any():
                    self.further.append([c[equal] for c in new])
                for c in (1, 2, 3):
                    level.columns[c][at[earlier]] = new[c][earlier]
                batch = Level(*(c[~same] for c in batch.columns))
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merge(b))

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Part, and place with a bit for each window offset, of all that lost something."""
        self.flush()
        whole = (1 << (self.reach + 1)) - 1
        parts = [p for p, _ in self.lost]
        found = [decisions(r, np.full(len(r), whole, np.uint64)) for _, r in self.lost]
        last = [level.columns for level in self.levels] + self.further
        if last:
            key, d, p, r = (np.concatenate(c) for c in zip(*last, strict=True))
            order = np.argsort(key, kind="stable")
            mask = lost_windows(key[order], d[order], self.length, self.reach)
            hit = mask != 0
            parts.append(p[order][hit])
            found.append(decisions(r[order][hit], mask[hit]))
        return (np.concatenate(parts), np.concatenate(found)) if parts else (np.zeros(0, np.int32), np.zeros(0, DECISION))


def decisions(r: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), DECISION)
    out["r"], out["m"] = r, m
    return out


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return out


def lost_windows(key: np.ndarray, d: np.ndarray, length: int, reach: int) -> np.ndarray:
    """For each segment of a sorted suffix array a bit per window offset: set if a smaller document has the window.

    A window that begins ``o`` bytes before the anchor is ``length - o`` bytes behind it and ``o`` before it. Neighbours in the
    order share a class of either while their common prefix is that long.
    """
    n = len(key)
    rows = key.view(np.uint8).reshape(n, -1)
    before, behind = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    right = common_prefix(rows[:, :length])
    left_order = np.argsort(text_order(rows[:, length : length + reach]), kind="stable")
    left = common_prefix(rows[left_order, length : length + reach])
    mask = np.zeros(n, np.uint64)
    left_class = np.empty(n, np.int64)
    for o in range(reach + 1):
        has = np.flatnonzero((before >= o) & (behind >= length - o))
        if len(has) < 2:
            continue
        left_class[left_order] = np.cumsum(left < o)
        window = np.cumsum(right < length - o)[has] * (n + 1) + left_class[has]
        order = np.lexsort((d[has], window))
        window, doc = window[order], d[has][order]
        new = np.append(True, window[1:] != window[:-1])
        lost = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[has[order[lost]]] |= U(1 << o)
    return mask


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "part", "batch", "share", "path", "payload"])


def shares_of(h: np.ndarray, shares: int) -> np.ndarray:
    return ((h >> U(40)) % U(shares)).astype(np.int64)


def pieces(values: np.ndarray):
    """(value, start, end) of each run of equal neighbours."""
    cut = np.flatnonzero(np.diff(values, prepend=-1, append=-1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(values[a]), a, b


class Batch:
    """Anchors of a batch of texts, those of documents with an id, and the distinct anchor runs by share."""

    def __init__(self, batch: pa.RecordBatch, shares: int, length: int, gram: int):
        self.raw, self.offsets = text_bytes(batch.column(1))
        self.found = Anchors(self.raw, self.offsets, length, gram)
        known = np.asarray(batch.column(0).is_valid())
        self.chosen = np.flatnonzero(known[self.found.doc])
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        self.d = ids[self.found.doc[self.chosen]].astype(np.int64)
        h = self.found.h[self.chosen]
        runs, self.run_of = np.unique(h, return_inverse=True)
        order = np.argsort(shares_of(runs, shares), kind="stable")
        self.runs = runs[order]
        self.share = shares_of(self.runs, shares)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.run_of = place[self.run_of]

    def in_several(self) -> np.ndarray:
        """Whether a run stands in two documents of the batch."""
        low, high = np.full(len(self.runs), np.iinfo(np.int64).max), np.full(len(self.runs), np.iinfo(np.int64).min)
        np.minimum.at(low, self.run_of, self.d)
        np.maximum.at(high, self.run_of, self.d)
        return low < high


def index_texts(docs: DataFrame, target: str, shares: int, length: int, gram: int) -> DataFrame:
    """Step 1: write the texts of each part; give 40 bits of each distinct run of a batch, and the file."""

    def work(batches):
        part, number = TaskContext.get().partitionId(), 0
        writer = PartWriter(target, part)
        for batch in batches:
            for a, b in byte_slices(batch.column(1), BATCH_BYTES):
                piece = batch.slice(a, b - a)
                writer.write(piece)
                own = Batch(piece, shares, length, gram)
                several = own.in_several()
                rows = []
                for share, i, j in pieces(own.share):
                    flags = np.packbits(several[i:j]).tobytes()
                    rows.append(("runs", part, number, share, None, len(own.runs[i:j]).to_bytes(4, "little") + pack_keys(own.runs[i:j]) + flags))
                if rows:
                    yield row_batch(rows)
                number += 1
        path = writer.close()
        if path:
            yield row_batch([("file", part, -1, part % shares, path, b"")])

    return docs.mapInArrow(roomy(work), ROWS)


def repeated_runs(rows: DataFrame, shares: int) -> DataFrame:
    """For each batch and share a bit per run: whether another document may have it (two batches, or two documents of one)."""

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            other = []
            for kind, part, number, share, path, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "runs":
                    n = int.from_bytes(payload[:4], "little")
                    flags = np.unpackbits(np.frombuffer(payload, np.uint8, -1, 4 + 5 * n), count=n).astype(bool)
                    held.append((part, number, share, unpack_keys(payload[4 : 4 + 5 * n]) | U(share << 40), flags))
                else:
                    other.append((kind, part, number, share, path, payload))
            if other:
                yield row_batch(other)
        if held:
            keys = np.concatenate([h[3] for h in held])
            _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
            repeated = count >= 2
            repeated[place[np.concatenate([h[4] for h in held])]] = True
            bits, at, out = repeated[place], 0, []
            for part, number, share, own, _ in held:
                mine = bits[at : at + len(own)]
                at += len(own)
                if mine.any():
                    out.append(("bits", part, number, share, None, np.packbits(mine).tobytes()))
                if len(out) >= 5000:
                    yield row_batch(out)
                    out = []
            if out:
                yield row_batch(out)

    return rows.repartitionById(shares, F.col("share")).mapInArrow(roomy(work), ROWS)


def scan_shares(rows: DataFrame, shares: int, length: int, gram: int) -> DataFrame:
    """Step 3: the family of suffix arrays of each share, and what its segments lose."""
    width = 2 * length - gram + 2

    def work(batches):
        families: dict[int, Family] = {}
        for batch in batches:
            for part, number, share, payload in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 5)), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(payload)
                n = len(raw) // (width + 12)
                d = np.frombuffer(raw, "<i8", n, width * n)
                r = np.frombuffer(raw, "<u4", n, (width + 8) * n).astype(np.int64) | (number << 32)
                families.setdefault(share, Family(length, gram)).add(np.frombuffer(raw, np.uint8, width * n).reshape(n, width), d, np.full(n, part, np.int32), r)
        for share in list(families):
            part, found = families.pop(share).close()
            order = np.argsort(part, kind="stable")
            out = [("lost", p, -1, share, None, found[order[a:b]].tobytes()) for p, a, b in pieces(part[order])]
            if out:
                yield row_batch(out)

    return rows.repartitionById(shares, F.col("share")).mapInArrow(roomy(work), ROWS)


def by_part(rows: DataFrame, parts: int, work_on, schema: str) -> DataFrame:
    """All rows about a part meet in one task, which reads the file of the part: ``work_on(batch, number, part, rows by kind)``."""

    def work(batches):
        held: dict[int, dict] = {}
        for batch in batches:
            for kind, part, number, share, path, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(part, {"path": None, "bits": {}, "lost": []})
                if kind == "file":
                    own["path"] = path
                elif kind == "bits":
                    own["bits"].setdefault(number, {})[share] = payload
                else:
                    own["lost"].append(np.frombuffer(payload, DECISION))
        for part, own in held.items():
            lost = np.concatenate(own["lost"]) if own["lost"] else np.zeros(0, DECISION)
            own["lost"] = lost[np.argsort(lost["r"], kind="stable")]
            for number, piece in enumerate(read_part(own["path"])):
                yield from work_on(piece, number, part, own)

    return rows.repartition(parts, "part").mapInArrow(roomy(work), schema)


def wanted_segments(own: Batch, bits: dict, gram: int):
    """Of the segments with repeated runs: places among the chosen ones, rows of bytes, and their order (``batch_winners``)."""
    wanted = np.zeros(len(own.runs), bool)
    for share, i, j in pieces(own.share):
        if share in bits:
            wanted[i:j] = np.unpackbits(np.frombuffer(bits[share], np.uint8), count=j - i)
    place = np.flatnonzero(wanted[own.run_of])
    rows = own.found.segments(own.chosen[place], gram)
    return place, rows, batch_winners(text_order(rows), own.d[place])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans removed (byte offsets), sha256 of the bytes kept."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    parts = rows.rdd.getNumPartitions()
    shares = max(8, 4 * parts)
    target = fresh_dir(docs.sparkSession, "repeats")
    runs = stored(repeated_runs(index_texts(rows, target, shares, length, gram), shares))

    def segments(piece, number, part, about):
        bits = about["bits"].get(number)
        if not bits:
            return
        own = Batch(piece, shares, length, gram)
        place, found, (order, new, _) = wanted_segments(own, bits, gram)
        first = order[new]
        share = own.share[own.run_of[place[first]]]
        by_share = np.argsort(share, kind="stable")
        press, out = zstandard.ZstdCompressor(level=1), []
        for s, a, b in pieces(share[by_share]):
            mine = first[by_share[a:b]]
            body = found[mine].tobytes() + own.d[place[mine]].astype("<i8").tobytes() + mine.astype("<u4").tobytes()
            out.append(("segments", part, number, s, None, press.compress(body)))
        if out:
            yield row_batch(out)

    lost = stored(scan_shares(by_part(runs, parts, segments, ROWS), shares, length, gram))

    def cut_out(piece, number, part, about):
        own = Batch(piece, shares, length, gram)
        depth = np.zeros(len(own.raw) + 1, np.int64)
        bits = about["bits"].get(number)
        if bits:
            place, found, (order, new, key_of) = wanted_segments(own, bits, gram)
            lo, hi = np.searchsorted(about["lost"]["r"], [number << 32, (number + 1) << 32])
            told = about["lost"][lo:hi]
            mask = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(mask, (told["r"] & 0xFFFFFFFF).astype(np.int64), told["m"])
            # equal segments of a document share what the first of them lost; those of larger documents lose all
            head = order[new][key_of]
            shared = np.zeros(len(place), np.uint64)
            shared[order] = np.where(own.d[place[order]] > own.d[place[head]], U((1 << (length - gram + 1)) - 1), mask[head])
            anchor, first, last = (x[own.chosen[place]] for x in (own.found.anchor, own.found.first, own.found.last))
            for o in range(length - gram + 1):
                start = anchor - o
                gone = (shared >> U(o) & U(1)).astype(bool) & (start >= first) & (start <= last)
                np.add.at(depth, start[gone], 1)
                np.add.at(depth, start[gone] + length, -1)
        yield describe(piece.column(0), own.raw, own.offsets, np.cumsum(depth)[:-1] > 0)

    return by_part(runs.unionByName(lost), parts, cut_out, RESULT)


def describe(ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """The result rows of some texts whose removed bytes are true in ``cut``."""
    edge = np.zeros(len(cut), bool)
    inner = offsets[:-1][offsets[:-1] < len(cut)]
    edge[inner] = True
    opens = cut & np.append(True, ~cut[:-1])[: len(cut)] | cut & edge
    last = np.append(edge[1:], True)[: len(cut)]
    closes = cut & np.append(~cut[1:], True)[: len(cut)] | cut & last
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    spans, removed, sha = [], [], []
    per_doc = np.searchsorted(doc, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        mine = slice(int(per_doc[i]), int(per_doc[i + 1]))
        spans.append([{"s": s - a, "e": e - a} for s, e in zip(start[mine].tolist(), end[mine].tolist(), strict=True)])
        bits = cut[a:b]
        removed.append(int(bits.sum()))
        sha.append(hashlib.sha256(raw[a:b][~bits].tobytes() if removed[-1] else raw[a:b].tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(sha)],
        ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"],
    )
