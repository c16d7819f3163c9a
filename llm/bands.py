"""Buckets of band keys: which nodes share a key, found without a row per key.

A task packs the (key, node) entries of a window of its rows into one blob per share of the keys. Of several nodes
of the window with one key only the smallest goes on; the others wait as local members. Each share then sorts
its entries: a key with two nodes or more is a bucket, and its smallest node is the pivot that the others are compared
with. A key that very many nodes have thus sends one entry per window, never one per node, and its local members are joined
with the pivot by Spark, which may split them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import broadcast_if_small, roomy, stored
from llm.hashing import U

#: Entries of one window.
WINDOW = 1 << 20
#: Bits of a key that are sent; with the share they tell keys apart.
BITS = 40
BLOBS = "kind string, share int, keys binary, nodes binary, flags binary"


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "share", "keys", "nodes", "flags"])


def pack_keys(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (BITS // 8), 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").ravel()


class Window:
    """Entries of some rows of a task; ``add`` gives the blobs of a full window."""

    def __init__(self, shares: int, spot: int):
        self.shares, self.spot = shares, spot  # local members stay spread over the shares
        self.nodes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, nodes: np.ndarray, keys: np.ndarray) -> list[tuple]:
        """``keys``: one row of keys per node."""
        self.nodes.append(nodes.astype(np.int64))
        self.keys.append(keys.view(np.uint64))
        self.size += keys.size
        return self.flush() if self.size >= WINDOW else []

    def flush(self) -> list[tuple]:
        if not self.size:
            return []
        nodes, at = np.unique(np.concatenate(self.nodes), return_index=True)
        keys = np.concatenate(self.keys)[at]
        self.nodes, self.keys, self.size = [], [], 0
        node = np.repeat(nodes, keys.shape[1])
        key = keys.ravel()
        share = (key >> U(BITS)) % U(self.shares)
        key = (share << U(BITS)) | (key & U((1 << BITS) - 1))
        order = np.argsort(key, kind="stable")  # nodes rise, so the smallest of a key comes first
        key, node = key[order], node[order]
        first = np.append(True, key[1:] != key[:-1])
        rows = []
        local = np.flatnonzero(~first)
        if len(local):
            self.spot = (self.spot + 1) % self.shares
            rows.append(("local", self.spot, key[local].tobytes(), node[local].tobytes(), None))
        flag = np.append(first[1:] == 0, False)[first]
        key, node = key[first], node[first]
        cut = np.flatnonzero(np.diff((key >> U(BITS)).astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            flags = np.packbits(flag[a:b]).tobytes() if flag[a:b].any() else None
            rows.append(("keys", int(key[a] >> U(BITS)), pack_keys(key[a:b]), node[a:b].tobytes(), flags))
        return rows


def share_members(batches):
    """Of the blobs of some shares: (key, node, pivot); local members without pivot; pivots of their keys without node."""
    keys, nodes, flags = [], [], []
    for batch in batches:
        kinds, shares = batch.column("kind").to_pylist(), batch.column("share").to_pylist()
        for i, kind in enumerate(kinds):
            key, node, flag = (batch.column(c)[i].as_py() for c in ("keys", "nodes", "flags"))
            node = np.frombuffer(node, np.int64)
            if kind == "local":
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)), pa.array(node), pa.nulls(len(node), pa.int64())], ["key", "node", "pivot"])
            else:
                keys.append(unpack_keys(key) | U(shares[i] << BITS))
                nodes.append(node)
                flags.append(np.zeros(len(node), bool) if flag is None else np.unpackbits(np.frombuffer(flag, np.uint8), count=len(node)).astype(bool))
    if not keys:
        return
    key, node, flag = np.concatenate(keys), np.concatenate(nodes), np.concatenate(flags)
    del keys, nodes, flags
    order = np.lexsort((node, key))
    key, node, flag = key[order], node[order], flag[order]
    first = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(first)
    pivot = np.repeat(node[start], np.diff(start, append=len(key)))
    other = (node != pivot) & (first | np.append(True, node[1:] != node[:-1]))
    for a in range(0, int(other.sum()), 100_000):
        at = np.flatnonzero(other)[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(node[at]), pa.array(pivot[at])], ["key", "node", "pivot"])
    flagged = start[np.maximum.reduceat(flag, start)]
    if len(flagged):
        yield pa.RecordBatch.from_arrays([pa.array(key[flagged].view(np.int64)), pa.nulls(len(flagged), pa.int64()), pa.array(node[flagged])], ["key", "node", "pivot"])


MEMBERS = "key long, node long, pivot long"


def with_pivots(found: DataFrame) -> DataFrame:
    """key, node, pivot of all members but the pivots. ``found``: the stored result of ``share_members``."""
    direct = found.filter("node is not null and pivot is not null")
    local = found.filter("node is not null and pivot is null").select("key", "node")
    pivots = found.filter("node is null").select("key", "pivot")
    met = local.join(broadcast_if_small(pivots, 200_000), "key").filter("node != pivot").select("key", "node", "pivot")
    return stored(direct.unionByName(met))


def bucket_members(keys: DataFrame) -> DataFrame:
    """key, node, pivot of all buckets with two nodes or more. ``keys``: node, keys array<long> of one length."""
    shares = max(8, 2 * keys.rdd.getNumPartitions())

    def work(batches):
        window = Window(shares, TaskContext.get().partitionId() % shares)
        for batch in batches:
            lists = batch.column(1)
            full = np.flatnonzero(np.asarray(lists.is_valid()))
            if len(full):
                table = lists.drop_null().flatten().to_numpy().reshape(len(full), -1)
                rows = window.add(batch.column(0).to_numpy()[full], table)
                if rows:
                    yield blob_batch(rows)
        rows = window.flush()
        if rows:
            yield blob_batch(rows)

    blobs = keys.select("node", "keys").mapInArrow(roomy(work), BLOBS)
    return with_pivots(stored(blobs.repartition(shares, "share").mapInArrow(roomy(share_members), MEMBERS)))
