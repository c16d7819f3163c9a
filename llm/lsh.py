"""Links between similar sets: band keys propose, full sets decide, and no bucket is expanded into all its pairs.

Round 1 compares every member of a bucket with the bucket's smallest node, and the confirmed links are joined into
components. A bucket needs more work only if it holds members of different components. For round 2 such buckets are
joined into groups by the members they share (or stay apart where the group is large and the buckets are not), and the members
of a group are cut into blocks; each pair of blocks meets in one task. There numpy compares the signatures of members of different components, full sets decide on
those that can be similar (estimate at most six standard deviations below the threshold), and only links that
join components leave the task. So each pair of bucket members is either compared, or known to be in one
component, or too far apart; nothing is dropped, whatever the size of a bucket.

Who meets whom is settled on ids. Only then texts are looked up, and they move once, to the task that compares them; sets,
which are several times as large as their texts, are made there and never move.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import broadcast_if_small, byte_slices, lengths, roomy, stored
from llm.components import connected_components
from llm.minmax import signatures

#: Members of a group in one block of round 2.
BLOCK = 256
#: A node that meets more than this many is compared with them in parts of about so many, so that it is not bound to one task.
PARTS = 64
#: Rows of one task of round 2.
TASK_ROWS = 4096
#: Bytes of texts whose sets are made at once in round 2.
SET_BYTES = 1 << 18
#: Tables of at most so many ids are broadcast to the texts; beyond it texts and ids are shuffled.
SMALL_IDS = 200_000

SetsOf = Callable[[pa.Array], list[np.ndarray]]
#: Rows with a column ``ask`` (a node) to the same rows with the ``text`` of that node behind them; a node of several texts gives several rows.
TextsOf = Callable[[DataFrame], DataFrame]


def texts_from(contents: DataFrame) -> TextsOf:
    """Texts of a table: node, text."""
    return lambda rows: contents.join(broadcast_if_small(rows, SMALL_IDS), F.col("ask") == F.col("node")).select(*rows.columns, "text")


def confirm(pairs: DataFrame, texts_of: TextsOf, sets_of: SetsOf, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with share[1] * intersection >= share[0] * union of their full sets.

    ``pairs``: a stored table. Rows of one (a, deal) come sorted with a itself first, as a stream of batches;
    a task holds the set of one a and one batch.
    """
    # most nodes meet few others and need their own text only once
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTS).alias("deals")).filter("deals > 1")
    deal = F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1)))
    asks = pairs.join(broadcast_if_small(many, SMALL_IDS), "a", "left").select("a", "b", deal.alias("deal"))
    rows = asks.select("a", "deal", F.col("b").alias("ask"), F.lit(1).alias("turn"))
    rows = rows.unionByName(asks.select("a", "deal").distinct().select("a", "deal", F.col("a").alias("ask"), F.lit(0).alias("turn")))
    # within one task's rows the turn comes last in the order, so the leading row of each group is first
    full = texts_of(stored(rows)).select("a", "deal", "turn", "ask", "text")
    full = full.repartition("a", "deal").sortWithinPartitions("a", "deal", "turn")

    def work(batches):
        lead, own = None, []
        for batch in batches:
            for lo, hi in byte_slices(batch.column(4)):
                part = batch.slice(lo, hi - lo)
                a, p, turn, ask = (part.column(i).to_numpy() for i in range(4))
                linked = np.zeros(len(a), bool)
                for i, s in enumerate(sets_of(part.column(4))):
                    if turn[i] == 0:
                        # a repeated id may bring several texts: each of them can link
                        own = [*own, s] if lead == (a[i], p[i]) else [s]
                        lead = (a[i], p[i])
                    else:
                        linked[i] = any(similar(x, s, share) for x in own)
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(ask[linked])], ["a", "b"])

    return full.mapInArrow(roomy(work), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    if not len(x) or not len(y):
        return False
    if share[0] * max(len(x), len(y)) > share[1] * min(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def similar_components(members: DataFrame, texts_of: TextsOf, sets_of: SetsOf, share: tuple[int, int], values: int = 192) -> DataFrame:
    """(node, component) of all nodes with a confirmed link. ``members``: key, node, pivot (``bands``)."""
    asked = stored(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(confirm(asked, texts_of, sets_of, share))
    labels = stored(connected_components(links))
    # the smallest node has met all others of its bucket: the rest of the bucket must be in one component
    state = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    sizes = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    state = stored(state.join(sizes.select("key", "n"), "key"))
    if state.isEmpty():
        return labels
    stars = state.join(state.groupBy("key").agg(F.min("node").alias("hub")), "key").select("node", "hub").distinct()
    groups = connected_components(stars, "node", "hub").select("node", F.col("component").alias("grp"))
    placed = stored(place_members(state, stored(groups)))
    found = stored(block_links(stored(block_pairs(placed)), texts_of, sets_of, share, values))
    return labels if found.isEmpty() else connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))


def place_members(state: DataFrame, groups: DataFrame) -> DataFrame:
    """node, comp, grp of the members that have to meet: those of buckets that share members, or, where that makes fewer rows, of one
    bucket. ``state``: key, node, comp; ``groups``: node, grp; both stored.

    Buckets join into ever larger groups as the input grows, and each member meets all blocks of its group; but it lies in few buckets.
    """
    dealt = lambda n: n * F.ceil(n / BLOCK)
    n = F.col("n")
    large = groups.groupBy("grp").agg(F.count("*").alias("n")).filter(n > BLOCK).select("grp", dealt(n).alias("together"))
    members = state.select("key", "node", "comp").distinct().join(groups, "node").join(broadcast_if_small(large, SMALL_IDS), "grp", "left")
    members = stored(members)
    buckets = members.filter("together is not null").groupBy("grp", "together", "key").agg(F.count("*").alias("n"))
    apart = buckets.groupBy("grp", "together").agg(F.sum(dealt(n)).alias("apart")).filter("apart < together").select("grp", F.lit(True).alias("split"))
    met = members.join(broadcast_if_small(apart, SMALL_IDS), "grp", "left")
    return met.select("node", "comp", F.when(F.col("split"), F.col("key")).otherwise(F.col("grp")).alias("grp")).distinct()


def block_pairs(placed: DataFrame) -> DataFrame:
    """grp, i, j (a pair of blocks of a group), own (the block of a member), ask (the member), comp: each member beside each block
    that its block has to meet. ``placed``: node, comp, grp."""
    # a component that fills blocks has them for itself, and they need not meet each other
    comps = stored(placed.groupBy("grp", "comp").agg(F.count("*").alias("n")))
    mixed = comps.filter(F.col("n") < BLOCK).groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK).alias("mixed"))
    sizes = comps.join(mixed, "grp", "left").select("grp", "comp", "n", F.coalesce("mixed", F.lit(1)).alias("mixed"))
    alone = F.col("n") >= BLOCK
    block = F.struct(
        F.when(alone, F.col("comp")).alias("of"),
        F.when(alone, F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.col("mixed"))).cast("long").alias("no"),
    )
    own = placed.join(broadcast_if_small(sizes, SMALL_IDS), ["grp", "comp"]).withColumn("own", block).drop("n", "mixed")
    blocks = own.select("grp", "own").distinct().groupBy("grp").agg(F.collect_list("own").alias("others"))
    meets = F.filter("others", lambda o: o["of"].isNull() | ~o["of"].eqNullSafe(F.col("own")["of"]))
    dealt = own.join(blocks, "grp").withColumn("other", F.explode(meets))
    number = lambda c: F.xxhash64(f"{c}.of", f"{c}.no")
    dealt = dealt.withColumns({"own": number("own"), "other": number("other")})
    return dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node").alias("ask"), "comp")


def with_signatures(texts: DataFrame, sets_of: SetsOf, values: int) -> DataFrame:
    """``texts`` (the last column is the text) without empty sets, plus a signature: the lowest byte of each of ``values`` min-max values."""
    names = [*texts.columns, "signature"]

    def work(batches):
        for batch in batches:
            for lo, hi in byte_slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                # rows of one member come together, and its signature is made once
                text = part.column(part.num_columns - 1).fill_null("").dictionary_encode()
                sets = sets_of(text.dictionary)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    table = signatures(np.concatenate([sets[k] for k in full]), np.array([len(sets[k]) for k in full]), -(-values // 2))
                    low = dict(zip(full, ((table >> 12).astype(np.uint8)), strict=True))
                    code = text.indices.to_pylist()
                    use = [k for k, c in enumerate(code) if c in low]
                    taken = part.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([low[code[k]].tobytes() for k in use], pa.binary())], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(roomy(work), f"{schema}, signature binary")


def block_links(pairs: DataFrame, texts_of: TextsOf, sets_of: SetsOf, share: tuple[int, int], values: int) -> DataFrame:
    """(a, b): confirmed links that join different components of a group. ``pairs``: a stored table of ``block_pairs``."""
    texts = texts_of(pairs).select("grp", "i", "j", "own", "ask", "comp", "text")
    # a row costs more processor time than bytes
    tasks = max(8, -(-pairs.count() // TASK_ROWS))
    rows = with_signatures(texts, sets_of, values).repartition(tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    target = share[0] / share[1]
    least = target - 6 * np.sqrt(target * (1 - target) / values)

    def near(unit, own, comp, sig):
        """Pairs (i, later ones) of members of different components whose sets can be similar."""
        first = own == unit[1]
        x = np.flatnonzero(first)
        y = x if unit[1] == unit[2] else np.flatnonzero(~first)
        for i in x.tolist():
            later = y[y > i] if unit[1] == unit[2] else y
            later = later[comp[later] != comp[i]]
            if len(later) and len(later := later[(sig[later] == sig[i]).mean(1) >= least]):
                yield i, later

    def asked(unit, held):
        """node, comp and candidates of a unit, the members that are candidates and their texts; nothing without candidates."""
        own, node, comp, sig = (np.concatenate([h[c] for h in held]) for c in range(4))
        found = list(near(unit, own, comp, sig))
        if found:
            need = np.unique(np.concatenate([np.array([i for i, _ in found]), *(k for _, k in found)]))
            yield node, comp, found, need, pa.concat_arrays([h[4] for h in held]).take(pa.array(need))

    def settled(waiting):
        texts = pa.concat_arrays([w[4] for w in waiting])
        sets = [s for lo, hi in byte_slices(texts, SET_BYTES) for s in sets_of(texts.slice(lo, hi - lo))]
        got, base = [], 0
        for node, comp, found, need, _ in waiting:
            own = dict(zip(need.tolist(), sets[base : base + len(need)], strict=True))
            base += len(need)
            for i, others in found:
                for k in others.tolist():
                    if comp[k] != comp[i] and similar(own[i], own[k], share):
                        got.append((node[i], node[k]))
                        comp[comp == comp[k]] = comp[i]
        if got:
            a, b = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def units(batches):
        held, unit = [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]
            sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(len(cols[0]), -1)
            new = np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
            cut = np.flatnonzero(new).tolist() + [len(cols[0])]
            for a, b in zip(cut[:-1], cut[1:], strict=True) if len(cols[0]) else ():
                here = (int(cols[0][a]), int(cols[1][a]), int(cols[2][a]))
                if here != unit and held:
                    yield unit, held
                    held = []
                unit = here
                held.append((cols[3][a:b], cols[4][a:b], cols[5][a:b], sig[a:b], batch.column(6).slice(a, b - a)))
        if held:
            yield unit, held

    def work(batches):
        waiting, size = [], 0
        for unit, held in units(batches):
            for w in asked(unit, held):
                waiting.append(w)
                size += int(lengths(w[4]).sum())
            if size >= SET_BYTES:
                yield from settled(waiting)
                waiting, size = [], 0
        if waiting:
            yield from settled(waiting)

    return rows.mapInArrow(roomy(work), "a long, b long")
