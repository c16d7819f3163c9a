"""Near-duplicate documents: word shingles, min-max signatures, banding, full-set confirmation, components.

Documents with equal shingle sets are one node from the start (equal 128-bit digests of the whole sets), so
exact copies cost nothing later. Band keys then propose pairs of nodes; ``lsh`` compares full sets.

Defined results: a text without words has no shingles and is linked with nothing; with fewer words than a shingle has,
the whole sequence is one shingle; a null id is linked with nothing and kept; rows that share an id count
as one document that has the links of all its texts; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bands import bucket_members
from llm.common import byte_slices, free_name, roomy, spread, stored, text_bytes
from llm.hashing import WHITE, U, mix, word_hashes
from llm.lsh import similar_components, texts_from
from llm.minmax import band_keys, signatures


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw, offsets = text_bytes(texts)
    start, words = word_hashes(raw, offsets, WHITE)
    edge = np.searchsorted(start, offsets)
    grams = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        grams = mix(grams + words[k : k + len(grams)])
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and band keys of each row (null digest and keys for empty sets)."""

    def work(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), width)
                count = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(count)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [None] * len(sets)
                if len(full):
                    table = band_keys(signatures(np.concatenate([sets[i] for i in full]), count[full], -(-bands * rows // 2)), rows)[:, :bands]
                    for i, k in zip(full.tolist(), table, strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(roomy(work), "doc_id long, n_shingles long, digest binary, keys array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(sketch(spread(texts), width, bands, rows))
    known = sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = stored(known.groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("s")).select("digest", F.col("s.doc_id").alias("node"), F.col("s.keys").alias("keys")))
    contents = texts.select(F.col("doc_id").alias("node"), "text")
    links = similar_components(bucket_members(nodes), texts_from(contents), lambda t: shingle_sets(t, width), (percent, 100), bands * rows)
    labels = nodes.select("digest", "node").join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    repeated = known.select("doc_id", "digest").distinct().groupBy("doc_id").count().filter("count > 1")
    if not repeated.isEmpty():
        # an id with several texts ties their components together
        tied = out.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("a"), F.coalesce("component_id", "doc_id").alias("b")).distinct()
        again = connected(tied)
        out = out.drop("component_id").join(again, F.col("doc_id") == F.col("node"), "left").withColumnRenamed("component", "component_id").drop("node")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept")
    )


def connected(pairs: DataFrame) -> DataFrame:
    from llm.components import connected_components

    return connected_components(pairs)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the documents that are not the first of their component; all columns."""
    found = near_duplicates(docs, width, percent, bands, rows, id_col, text_col)
    name = free_name(docs, "gone")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
