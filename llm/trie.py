"""The prefix trie of conversations, as one row per node.

A conversation is a sequence of turns, and a node is a distinct sequence of first turns. Texts stay where they are:
a turn travels as the 128-bit digest of (role, text) and its number of words.

1. Equal sequences are reduced to one with its smallest id, its copies and the digest of the ids that end there.
   Ids of a frequent sequence are joined to text in pieces by many tasks; only the pieces meet to be hashed in order.
2. Sequences are dealt into shards by their first turn. Prefixes that hold more than ``shard_turns`` turns are cut
   again, after 2, 4, 8, ... turns, until every shard is small, so a hot first turn is not one task.
3. Tasks pack the sequences of their shards into double arrays (``doublearray``) over dense turn numbers and walk
   them; nodes below the cut of their shard are complete there, with their subtree.
4. Nodes above a cut (the root, and prefixes of hot shards) are in several tries. Their counts are merged globally by a
   digest of the path. What a merged node itself adds to the subtrees of its ancestors is only known then; it goes up
   along the path of its smallest conversation, so each node is counted once and no level-by-level loop is needed.

Defined results: a null turn comes first, then by number; turns of equal number stand by role, then by the digest of
role and text; null roles and texts are empty; repeated rows are turns each; rows without conversation id are
left out; extra columns are ignored; an empty table gives no row. The digests of one conversation (not its texts) must fit
into a row, and so must the ids of one node's digest pieces (a megabyte each).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import broadcast_if_small, stored
from llm.doublearray import DoubleArray

SHARD_TURNS = 500_000
#: Shards are also kept below the fair share of a task, but prefixes of fewer turns than this are not cut.
LEAST_SHARD = 1_000
PIECE_BYTES = 1 << 20
ROOT = bytes(16)
EMPTY_SHA = hashlib.sha256().hexdigest()
PARTS = "kind string, conv_id long, depth int, parent_conv_id long, parent binary, node binary, path array<binary>, n_convs long, n_children long, n_leaves long, saved long, words long, ends string"


def turn_sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<struct<key, words>> in order; one row per conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), words.alias("words")).alias("t")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(sequences: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first conversation of its group of ids;
    h is the checksum of the id modulo ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = sequences.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.array().cast(sequences.schema["turns"].dataType)
    both = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return sequences.withColumn("base", base).join(heads, "base", "left").select("conv_id", both.alias("turns"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """conv_id (smallest), copies, ends (digest of the ids), keys, words: one row per distinct sequence."""
    keyed = sequences.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    keyed = stored(keyed.withColumn("seq", F.md5(F.array_join("keys", ""))))
    groups = keyed.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    several = keyed.join(groups.filter("copies > 1").select("seq"), "seq", "left_semi").select("seq", "conv_id")
    ends = id_digests(several)
    one = groups.join(keyed.select("conv_id", "keys", "words"), "conv_id").join(ends, "seq", "left")
    alone = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return stored(one.select("conv_id", "copies", F.coalesce("ends", alone).alias("ends"), "keys", "words"))


def id_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): the SHA-256 of the ids of each sequence, ascending, with commas between them."""

    def joined(batches):
        seq, first, held, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([first], pa.int64()), pa.array([",".join(held).encode()], pa.binary())], ["seq", "first", "ids"])

        for batch in batches:
            for s, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (s != seq or size >= PIECE_BYTES):
                    yield piece()
                    held, size = [], 0
                if not held:
                    seq, first = s, i
                held.append(str(i))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def hashed(batches):
        seq, state = None, None
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if s != seq:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends"])
                    seq, state = s, hashlib.sha256(raw.as_buffer())
                else:
                    state.update(b",")
                    state.update(raw.as_buffer())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends"])

    cores = members.sparkSession.sparkContext.defaultParallelism
    pieces = members.repartitionByRange(max(cores, members.rdd.getNumPartitions()), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = pieces.mapInArrow(joined, "seq string, first long, ids binary")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq string, ends string")


def cut_shards(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """``sequences`` plus cut (turns of the prefix that makes the shard) and shard (digest of that prefix)."""
    level, done, cut = sequences, None, 1
    while True:
        keyed = level.withColumns({"cut": F.lit(cut), "shard": F.md5(F.array_join(F.slice("keys", 1, cut), ""))})
        weight = keyed.groupBy("shard").agg(F.sum(F.size("keys") + 1).alias("turns"), F.count("*").alias("n"))
        heavy = stored(weight.filter((F.col("turns") > shard_turns) & (F.col("n") > 1)).select("shard"))
        count = heavy.count()
        light = keyed.join(broadcast_if_small(heavy, 100_000), "shard", "left_anti") if count else keyed
        done = light if done is None else done.unionByName(light)
        if not count:
            return done
        level = stored(keyed.join(broadcast_if_small(heavy, 100_000), "shard", "left_semi").drop("cut", "shard"))
        cut *= 2


def trie_parts(sharded: DataFrame, shard_turns: int, total: int) -> DataFrame:
    """Rows of three kinds: ``own`` (complete nodes), ``upper`` (parts of shared nodes) and ``path`` (of the smallest
    conversations of shared nodes)."""

    def work(batches):
        held, turns, shard = [], 0, None
        for batch in batches:
            names = batch.column(6)
            edge = np.flatnonzero(np.asarray(pc.not_equal(names[1:], names[:-1]))) + 1 if len(names) > 1 else np.zeros(0, int)
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(names)], strict=True):
                if a == b:
                    continue
                here = names[a].as_py()
                if turns >= shard_turns and here != shard:
                    yield from trie_rows(pa.Table.from_batches(held))
                    held, turns = [], 0
                shard = here
                part = batch.slice(a, b - a)
                held.append(part)
                turns += len(part) + len(part.column(3).flatten())
        if held:
            yield from trie_rows(pa.Table.from_batches(held))

    rows = sharded.select("conv_id", "copies", "ends", "keys", "words", "cut", "shard")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, -(-total // shard_turns))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(work, PARTS)


def trie_rows(table: pa.Table):
    """The nodes of the trie of some whole shards."""
    table = table.combine_chunks()
    conv, copies, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("conv_id", "copies", "cut"))
    keys = table.column("keys").combine_chunks()
    length = np.asarray(keys.value_lengths()).astype(np.int64)
    coded = keys.flatten().dictionary_encode()
    words = table.column("words").combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = table.column("ends").to_pylist()
    trie = DoubleArray(coded.indices.to_numpy().astype(np.int64), length)

    size = len(trie.base)
    depth = np.zeros(size, np.int64)
    n, own_words, edge, end = (np.zeros(size, np.int64) for _ in range(4))
    least = np.full(size, np.iinfo(np.int64).max)
    edge[:] = np.iinfo(np.int64).max
    end[:] = -1
    turn = np.zeros(size, np.int64)
    n[0], least[0], edge[0] = copies.sum(), conv.min(), cut.min()
    end[np.zeros(int((length == 0).sum()), np.int64)] = np.flatnonzero(length == 0)
    for d, (active, state) in enumerate(trie.walk(), 1):
        depth[state] = d
        np.add.at(n, state, copies[active])
        np.minimum.at(least, state, conv[active])
        np.minimum.at(edge, state, cut[active])
        place = trie.start[active] + d - 1
        own_words[state] = words[place]
        turn[state] = place
        last = length[active] == d
        end[state[last]] = active[last]

    used = np.flatnonzero(trie.check >= 0)
    used = used[np.argsort(depth[used], kind="stable")]
    parent = trie.check
    upper = depth < edge
    own_children = np.zeros(size, np.int64)
    children = np.bincount(parent[used[1:]], minlength=size)
    own = used[~upper[used]]
    np.add.at(own_children, parent[own], 1)
    leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    leaves[own] = children[own] == 0
    saved[own] = (n[own] - 1) * own_words[own]
    level = np.flatnonzero(np.diff(depth[used], prepend=-1, append=-1))
    for a, b in reversed(list(zip(level[1:-1].tolist(), level[2:].tolist(), strict=True))):
        states = used[a:b]
        np.add.at(leaves, parent[states], leaves[states])
        np.add.at(saved, parent[states], saved[states])

    # the names of shared nodes: a digest of the path, equal in every trie
    shared = used[upper[used]]
    names, path = {0: ROOT}, {0: [ROOT]}
    text = coded.dictionary
    codes = coded.indices
    for s in shared.tolist():
        if s:
            names[s] = hashlib.blake2b(names[int(parent[s])] + text[codes[int(turn[s])].as_py()].as_py().encode(), digest_size=16).digest()
    ended = lambda states: [ends[e] if e >= 0 else None for e in end[states].tolist()]

    def batch(kind, states, **columns):
        k = len(states)
        none = [None] * k
        get = lambda name, of=none: columns.get(name, of)
        types = {"conv_id": pa.int64(), "depth": pa.int32(), "parent_conv_id": pa.int64(), "parent": pa.binary(), "node": pa.binary(), "path": pa.list_(pa.binary())}
        arrays = [pa.array([kind] * k)] + [pa.array(get(c), t) for c, t in types.items()]
        arrays += [pa.array(get(c), pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved", "words")] + [pa.array(get("ends"), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", *types, "n_convs", "n_children", "n_leaves", "saved", "words", "ends"])

    for a in range(0, len(own), 20_000):
        s = own[a : a + 20_000]
        above = parent[s]
        open_parent = upper[above]
        yield batch(
            "own", s, conv_id=least[s], depth=depth[s].astype(np.int32), parent_conv_id=pa.array(least[above], mask=open_parent), parent=[names[p] if o else None for p, o in zip(above.tolist(), open_parent.tolist(), strict=True)],
            n_convs=n[s], n_children=children[s], n_leaves=leaves[s], saved=saved[s], ends=ended(s),
        )
    yield batch(
        "upper", shared, conv_id=least[shared], depth=depth[shared].astype(np.int32), parent=[names[int(parent[s])] if s else None for s in shared.tolist()], node=[names[s] for s in shared.tolist()],
        n_convs=n[shared], n_children=own_children[shared], n_leaves=leaves[shared], saved=saved[shared], words=own_words[shared], ends=ended(shared),
    )
    # states come by depth, so the deepest shared node of each smallest conversation is the last one
    deepest = dict(zip(least[shared].tolist(), shared.tolist(), strict=True))
    for c, s in deepest.items():
        path = []
        while s:
            path.append(names[s])
            s = int(parent[s])
        yield batch("path", [c], conv_id=[c], path=[[ROOT, *reversed(path)]])


def merge_upper(parts: DataFrame) -> DataFrame:
    """The shared nodes, whole: node, parent, conv_id, depth, n_convs, n_children, n_leaves, saved, ends."""
    total = lambda c: F.sum(c).alias(c)
    merged = parts.filter("kind = 'upper'").groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("words").alias("words"), F.max("ends").alias("ends"),
        total("n_convs"), total("n_children"), total("n_leaves"), total("saved"),
    )
    merged = stored(merged)
    below = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    merged = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    merged = stored(merged)
    # what a node adds itself, sent up the path of its smallest conversation
    adds = merged.select("conv_id", F.struct("depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")).alias("a"))
    adds = adds.groupBy("conv_id").agg(F.collect_list("a").alias("adds"))
    paths = parts.filter("kind = 'path'").select("conv_id", "path")

    def upwards(batches):
        for batch in batches:
            for path, adds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add = np.zeros((len(path), 2), np.int64)
                for x in adds:
                    add[x["depth"]] += (x["saved"], x["leaf"])
                add = np.cumsum(add[::-1], 0)[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.binary()), pa.array(add[:, 0]), pa.array(add[:, 1])], ["node", "add_saved", "add_leaves"])

    sums = adds.join(paths, "conv_id").select("path", "adds").mapInArrow(upwards, "node binary, add_saved long, add_leaves long")
    sums = sums.groupBy("node").agg(F.sum("add_saved").alias("add_saved"), F.sum("add_leaves").alias("add_leaves"))
    out = merged.join(sums, "node", "left")
    return out.withColumns({"saved": F.col("saved") + F.coalesce("add_saved", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("add_leaves", F.lit(0))})


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, turns array<struct<key, words>>)."""
    distinct = distinct_sequences(sequences)
    total = distinct.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    fair = total // (4 * distinct.sparkSession.sparkContext.defaultParallelism)
    shard_turns = min(shard_turns, max(LEAST_SHARD, fair))
    parts = stored(trie_parts(cut_shards(distinct, shard_turns), shard_turns, total))
    upper = stored(merge_upper(parts))
    above = broadcast_if_small(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), 100_000)
    own = parts.filter("kind = 'own'").drop("node", "path", "words", "kind")
    return node_rows(own.join(above, "parent", "left")).unionByName(node_rows(upper.join(above, "parent", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))))


def node_rows(nodes: DataFrame) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    parent: Column = F.coalesce("parent_conv_id", "above").alias("parent_conv_id")
    return nodes.select("conv_id", long("depth"), parent, "n_convs", long("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
