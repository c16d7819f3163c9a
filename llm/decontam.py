"""Benchmark decontamination with a positional inverted index of the training tokens.

1. Count how often each benchmark word occurs in all documents (one pass, counts are summed in tasks first), and take the
   two rarest words of each window of ``window`` consecutive item words; tasks do that, item by item.
2. Store the postings of these terms: (term, document, positions), clustered by term and a part of the document id, so that no
   term is one task and the list of a term is read together.
3. Intersect from the rarest term: its list meets that of the second rarest in the same document. Offset-adjusted positions
   that both have are places where the item can begin. For proximity the two only need to stand in one stretch, in
   any order and at any distance: positions become overlapping blocks of twice the stretch, so each stretch is inside one
   block. Both are set intersections inside a row; no pair of positions is made.
4. Only documents with such a place or block are read again, and whole items are laid beside them: runs of at least
   a window of equal words are exact phrase matches. A window is a proximity match where all its words occur, in any
   order, in a stretch of the text ``slop`` words longer than the window (a shorter text is one stretch, if
   it has as many words as the window).

Words are lower-case (A-Z) runs of letters, digits and all bytes above ASCII, known by 64-bit hashes. Items, their
words and names stay in tables. What goes to the tasks are the sorted hashes of benchmark words, of at most ``block_words``
words of items at a time: a benchmark of more words is taken in several passes.

Defined results: null and empty texts have no words and no hits; items without words are left
out; items without id hit words and contaminate, but have no name in item_ids; rows of equal id and text get equal results; equal item ids count once; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import hashing
from llm.common import broadcast_if_small, byte_slices, free_name, roomy, row_key, spread, stored, text_bytes
from llm.hashing import NOT_ALNUM

HITS = "doc_id long, tie long, spans array<struct<s:int,e:int>>, items array<long>, near array<long>"
#: Tables of at most so many (narrow) rows are sent to the tasks.
SMALL_PAIRS, SMALL_DOCS = 200_000, 20_000


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts, and the number of words of each text."""
    raw, offsets = text_bytes(texts)
    start, hashes = hashing.word_hashes(raw, offsets, NOT_ALNUM)
    return hashes, np.diff(np.searchsorted(start, offsets))


def member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x its place in the sorted values, and whether it is there."""
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool)


def item_table(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number), name, words: one row per distinct item that has words."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).distinct()

    def work(batches):
        for batch in batches:
            words, count = word_hashes(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["name", "words"])

    found = stored(rows.mapInArrow(roomy(work), "name string, words array<long>").filter("size(words) > 0"))
    # numbered over the stored rows, so that the numbers are the same for all that follow
    return stored(found.withColumn("item", F.monotonically_increasing_id()))


def sorted_values(column: DataFrame, name: str) -> np.ndarray:
    """The distinct values of a bounded column."""
    return np.sort(column.select(name).distinct().toPandas()[name].to_numpy(np.int64).view(np.uint64))


def term_counts(docs: DataFrame, terms) -> DataFrame:
    """term (its place among the sorted ``terms``, a broadcast), n: how often it occurs in all texts."""

    def work(batches):
        known = terms.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                at, there = member(known, word_hashes(batch.column(0).slice(a, b - a))[0])
                total += np.bincount(at[there], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return docs.select("text").mapInArrow(roomy(work), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


PAIRS = "item long, a int, b int, rare long, second long, stretch int"


def rarest_pairs(items: DataFrame, terms, counts, window: int, slop: int) -> DataFrame:
    """Of each window that can occur: places of its rarest and second rarest word in the item, and the two words."""

    def work(batches):
        known, total = terms.value, counts.value
        for batch in batches:
            rows = []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.values.to_numpy().view(np.uint64)
                n = total[member(known, words)[0]]
                size = min(window, len(words))
                pairs = set()
                for w in range(len(words) - size + 1):
                    order = w + np.argsort(n[w : w + size], kind="stable")
                    if n[order].min() > 0:
                        pairs.add((int(order[0]), int(order[min(1, size - 1)])))
                rows += [(item, a, b, int(words[a].view(np.int64)), int(words[b].view(np.int64)), size + slop) for a, b in sorted(pairs)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PAIRS.split(", ")])

    return spread(items.select("item", "words")).mapInArrow(roomy(work), PAIRS)


POSTINGS = "doc_id long, tie long, n_words long, term long, positions array<int>"


def positional_index(docs: DataFrame, terms) -> DataFrame:
    """A row per document and term with the positions, and a row without term per document with its number of words."""

    def work(batches):
        known = terms.value
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                words, count = word_hashes(batch.column(2).slice(a, b - a))
                at, there = member(known, words)
                place = np.flatnonzero(there)
                doc = np.searchsorted(np.cumsum(count), place, "right")
                term, pos = at[place], place - (np.cumsum(count) - count)[doc]
                order = np.lexsort((pos, term, doc))
                doc, term, pos = doc[order], term[order], pos[order]
                new = np.flatnonzero(np.diff(doc * (len(known) + 1) + term, prepend=-1))
                n, m = len(count), len(new)
                ends = np.concatenate([np.zeros(n, np.int32), np.append(new, len(doc)).astype(np.int32)])
                none = np.concatenate([np.ones(n, bool), np.zeros(m, bool)])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))
                owner = pa.array(np.concatenate([np.arange(n), doc[new]]))
                code = np.concatenate([np.zeros(n, np.int64), known[term[new]].view(np.int64) if m else np.zeros(0, np.int64)])
                size = np.concatenate([count, np.zeros(m, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(owner), batch.column(1).slice(a, b - a).take(owner), pa.array(size, mask=~none), pa.array(code, mask=none), lists],
                    ["doc_id", "tie", "n_words", "term", "positions"],
                )

    return docs.mapInArrow(roomy(work), POSTINGS)


#: The list of a term lies in this many parts of the index, by document.
TERM_PARTS = 16


def candidates(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, tie, item, near, shift): places where the two rarest terms of a window meet.

    Without ``near`` both stand at their distance in the item, and shift is the word of the text where the item would
    start. With it they stand in one block, and shift is the number of the block.
    """
    lists = index.select("term", "doc_id", "tie", "positions")
    first = lists.join(broadcast_if_small(pairs, SMALL_PAIRS), F.col("term") == F.col("rare")).drop("term", "rare").withColumnRenamed("positions", "here")
    # the list of the second term is looked up in the documents of the first; a pair may be one word
    again = lists.withColumnsRenamed({"term": "_second", "doc_id": "_id", "tie": "_tie", "positions": "there"})
    both = first.join(again, (F.col("second") == F.col("_second")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    shifted = lambda c, place: F.transform(c, lambda p: p - F.col(place))
    number = lambda c: F.transform(c, lambda p: F.floor(p / F.col("stretch")).cast("int"))
    blocks = lambda c: F.array_distinct(F.concat(number(c), F.transform(number(c), lambda x: x - 1)))
    exact = F.transform(F.array_intersect(shifted("here", "a"), shifted("there", "b")), lambda x: F.struct(F.lit(False).alias("near"), x.alias("shift")))
    near = F.transform(F.array_intersect(blocks("here"), blocks("there")), lambda x: F.struct(F.lit(True).alias("near"), x.alias("shift")))
    return both.select("doc_id", "tie", "item", F.explode(F.concat(exact, near)).alias("place")).select("doc_id", "tie", "item", "place.near", "place.shift").distinct()


def stretch_holds(needed: np.ndarray, least: np.ndarray, item: np.ndarray, part: np.ndarray, stretch: int) -> bool:
    """Whether a stretch of ``part`` has all the words of a window. ``item``: its distinct words in order; ``needed``:
    which of them each window has, ``least`` how many."""
    at, there = member(item, part)
    seen = np.zeros((len(part) + 1, len(item)), np.int32)
    seen[1:][there, at[there]] = 1
    if not (needed @ seen.any(0) >= least).any():
        return False
    seen = np.cumsum(seen, 0)
    stretch = min(stretch, len(part))
    has = seen[stretch:] > seen[: len(seen) - stretch]
    return bool((has.astype(np.float32) @ needed.T >= least).any())


def match_items(rows: DataFrame, window: int, slop: int) -> DataFrame:
    """``rows``: doc_id, tie, text and asked array<struct<item, words, places array<struct<near, shift>>>>; gives spans of words
    hit, items and near items."""

    def windows_of(item: np.ndarray):
        """The distinct words of an item; which of them each window has, and how many."""
        size = min(window, len(item))
        distinct, place = np.unique(item, return_inverse=True)
        needed = np.zeros((len(item) - size + 1, len(distinct)), np.float32)
        for w in range(len(needed)):
            needed[w, place[w : w + size]] = 1
        return distinct, needed, needed.sum(1), size

    def one(words: np.ndarray, asked):
        spans, found, near = [], [], []
        for ask in asked:
            item, hit = np.array(ask["words"], np.int64).view(np.uint64), False
            size = min(window, len(item))
            for shift in [p["shift"] for p in ask["places"] if not p["near"]]:
                a, b = max(0, -shift), min(len(item), len(words) - shift)
                equal = np.zeros(len(item) + 2, np.int8)
                if b > a:
                    equal[a + 1 : b + 1] = item[a:b] == words[a + shift : b + shift]
                edge = np.diff(equal)
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                long = end - start >= size
                if long.any():
                    hit = True
                    spans += [{"s": s + shift, "e": e + shift} for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            if hit:
                found.append(ask["item"])
                continue
            blocks = [p["shift"] for p in ask["places"] if p["near"]]
            if blocks:
                distinct, needed, least, size = windows_of(item)
                stretch = size + slop
                for number in blocks:
                    # all stretches that begin in the block; at the end of the text the last one
                    begin = max(0, min(number * stretch, len(words) - stretch))
                    part = words[begin : max(0, (number + 2) * stretch)]
                    if len(part) >= size and stretch_holds(needed, least, distinct, part, stretch):
                        near.append(ask["item"])
                        break
        return spans, found, near

    def work(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                words, count = word_hashes(batch.column(2).slice(a, b - a))
                ends = np.cumsum(count)
                out = [one(words[e - n : e], p) for n, e, p in zip(count, ends, batch.column(3).slice(a, b - a).to_pylist(), strict=True)]
                spans, found, near = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(found, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                    ["doc_id", "tie", "spans", "items", "near"],
                )

    return rows.mapInArrow(roomy(work), HITS)


def covered(spans):
    """How many places the spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))
    step = lambda x, s: F.struct(
        (x["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], x["upto"]))).alias("n"), F.greatest(x["upto"], s["e"]).alias("upto")
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda x: x["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, block_words: int = 4_000_000, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tie (hash of the text), n_words, n_hit, spans, item_ids, near_item_ids (strings)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("tie"), F.col(text_col).alias("text"))
    every = item_table(benchmark, item_col, item_text_col)
    passes = max(1, -(-(every.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    base, hits = None, []
    for number in range(passes):
        items = every.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number) if passes > 1 else every
        terms = share(sorted_values(items.select(F.explode("words").alias("w")), "w"))
        counts = np.zeros(len(terms.value), np.int64)
        if len(counts):
            known = term_counts(spread(rows.select("text")), terms).toPandas()
            counts[known["term"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
        pairs = stored(rarest_pairs(items, terms, share(counts), window, slop))
        used = sorted_values(pairs.select(F.explode(F.array("rare", "second")).alias("w")), "w")
        if base is not None and not len(used):
            continue
        part = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(TERM_PARTS))
        scan = positional_index(spread(rows), share(used))
        index = stored(scan.repartition("term", part).sortWithinPartitions("term") if len(used) else scan)
        base = index.filter("term is null").select("doc_id", "tie", "n_words") if base is None else base
        if not len(used):
            continue
        places = candidates(index.filter("term is not null"), pairs)
        asked = places.groupBy("doc_id", "tie", "item").agg(F.collect_set(F.struct("near", "shift")).alias("places"))
        asked = asked.join(broadcast_if_small(items.select("item", "words"), SMALL_PAIRS, F.size("words")), "item")
        asked = stored(asked.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("item", "words", "places")).alias("asked")))
        held = F.aggregate("asked", F.lit(0).cast("long"), lambda n, x: n + F.size(x["words"]) + F.size(x["places"]))
        text = rows.join(broadcast_if_small(asked, SMALL_DOCS, held), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("doc_id", "tie", "text", "asked")
        hits.append(stored(match_items(text, window, slop).dropDuplicates(["doc_id", "tie"])))
    merged = hits[0] if hits else spark.createDataFrame([], HITS)
    for more in hits[1:]:
        merged = merged.unionByName(more)
    # names come from their table, in one row per document and item that occurs
    names = every.filter("name is not null").select("item", "name")
    told = merged.select("doc_id", "tie", F.explode(F.concat(F.transform("items", lambda i: F.struct(i.alias("item"), F.lit(False).alias("near"))), F.transform("near", lambda i: F.struct(i.alias("item"), F.lit(True).alias("near"))))).alias("x"))
    told = told.select("doc_id", "tie", "x.*").join(broadcast_if_small(names, SMALL_PAIRS), "item").groupBy("doc_id", "tie")
    told = told.agg(F.collect_set(F.when(~F.col("near"), F.col("name"))).alias("item_ids"), F.collect_set(F.when(F.col("near"), F.col("name"))).alias("near_item_ids"))
    spans = merged.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = lambda df, n: df.withColumnsRenamed({"doc_id": f"_id{n}", "tie": f"_tie{n}"})
    same = lambda n: F.col("doc_id").eqNullSafe(F.col(f"_id{n}")) & (F.col("tie") == F.col(f"_tie{n}"))
    out = base.join(keyed(spans, 1), same(1), "left").join(keyed(told, 2), same(2), "left").drop("_id1", "_tie1", "_id2", "_tie2")
    none = F.array().cast("array<string>")
    found = F.array_sort(F.coalesce("item_ids", none))
    return out.withColumns(
        {
            "spans": F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")),
            "item_ids": found,
            "near_item_ids": F.array_sort(F.array_except(F.coalesce("near_item_ids", none), found)),
        }
    ).withColumn("n_hit", covered(F.col("spans")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns."""
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("n_hit > 0")
    doc, tie = free_name(docs, "gone_doc"), free_name(docs, "gone_tie")
    gone = broadcast_if_small(stored(found.select(F.col("doc_id").alias(doc), F.col("tie").alias(tie)).distinct()), SMALL_PAIRS)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (row_key(text_col) == F.col(tie)), "left_anti")
