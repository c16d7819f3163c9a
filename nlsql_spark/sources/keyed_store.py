"""A vector store that knows its ids: hash buckets, a Bloom filter per bucket and commit, commits by manifest.

    store/data/SEGMENT/bucket=B/*.parquet     example_id, embedding
    store/commits/KEY/                        a manifest table: segment, bucket, rows, bits (the filter); counts once Spark ended it

A batch is compared with filters first. Only ids that a filter knows are looked up, only in the buckets where they can be,
and only their id column is read, so what a batch of new ids reads does not grow with the vectors in the store. A commit of a key
that is there is not done again; data without a manifest is never read. There is one writer at a time.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark.session import broadcast_if_small, materialize
from nlsql_spark.sources.files import EMBEDDING_SCHEMA, path_exists

BUCKETS = 16
BITS_PER_ID, PROBES = 10, 7
MANIFEST = "segment string, bucket int, rows long, bits binary"
#: More commits than this are merged into one before the next is added.
MOST_COMMITS = 64
#: Filters of more bytes than this are not sent with the tasks but dealt out by bucket.
FILTER_BYTES = 32 << 20


def bucket_of(id_col: str = "example_id"):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS)).cast("int")


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A fixed 64-bit mix of each id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def probes(ids: np.ndarray, size: int) -> np.ndarray:
    """(ids, probes) places in a filter of ``size`` bits."""
    with np.errstate(over="ignore"):
        step = mixed(ids, 0x9E3779B97F4A7C15) | np.uint64(1)
        return (mixed(ids, 1)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def bloom(ids: np.ndarray) -> bytes:
    size = max(64, -(-len(ids) * BITS_PER_ID // 8) * 8)
    bits = np.zeros(size, bool)
    bits[probes(ids, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """False only for ids that are surely not in the filter."""
    known = np.frombuffer(bits, np.uint8)
    at = probes(ids, len(known) * 8)
    return (known[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)


def commit_keys(spark: SparkSession, store: str) -> list[str]:
    if not path_exists(spark, f"{store}/commits"):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/commits")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(n for n in names if path_exists(spark, f"{store}/commits/{n}/_SUCCESS"))


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """segment, bucket, rows, bits of all committed segments; of merged ones only the merged."""
    keys = commit_keys(spark, store)
    merged = [k for k in keys if k.startswith("merged-")]
    if merged:
        last = max(merged)
        gone = set(spark.read.text(f"{store}/replaced/{last}").toPandas()["value"])
        keys = [k for k in keys if k not in gone]
    if not keys:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(*[f"{store}/commits/{k}" for k in keys])


def known_ids(ids: DataFrame, store: str) -> DataFrame:
    """Those of the (distinct) ids that the store has."""
    spark = ids.sparkSession
    filters = manifest(spark, store)
    asked = ids.select("example_id", bucket_of().alias("bucket"))
    size = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size <= FILTER_BYTES:
        held: dict[int, list] = {}
        for row in filters.select("bucket", "segment", "bits").collect():
            held.setdefault(row["bucket"], []).append((row["segment"], bytes(row["bits"])))

        def check_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for bucket, part in pdf.groupby("bucket"):
                    yield from hits(part["example_id"].to_numpy(), int(bucket), held.get(int(bucket), []))

        possible = asked.mapInPandas(check_batches, HITS)
    else:

        def check(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"example_id": [], "segment": [], "bucket": []}).astype({"example_id": "int64", "segment": "object", "bucket": "int32"})
            if asks.empty:
                return none
            return pd.concat([none, *hits(asks["example_id"].to_numpy(), int(asks["bucket"].iloc[0]), zip(known["segment"], known["bits"]))])

        # a bucket that very many ids ask for is four groups
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("example_id", F.lit(3)), F.lit(4)))
        every = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
        possible = salted.groupBy("bucket", "salt").cogroup(every.groupBy("bucket", "salt")).applyInPandas(check, HITS)
    possible = materialize(possible)
    # at most one row per bucket and segment
    places = possible.select("segment", "bucket").distinct().collect()
    if not places:
        return ids.select("example_id").limit(0)
    paths = [f"{store}/data/{r['segment']}/bucket={r['bucket']}" for r in sorted(places)]
    have = spark.read.schema("example_id bigint").option("recursiveFileLookup", "true").parquet(*paths)
    return have.join(broadcast_if_small(possible.select("example_id").distinct()), "example_id", "left_semi").distinct()


HITS = "example_id long, segment string, bucket int"


def hits(ids: np.ndarray, bucket: int, filters) -> Iterator[pd.DataFrame]:
    """The ids that a filter of the bucket knows, per segment."""
    for segment, bits in filters:
        found = ids[may_hold(bits, ids)]
        if len(found):
            yield pd.DataFrame({"example_id": found, "segment": segment, "bucket": np.full(len(found), bucket, np.int32)})


def pending_rows(df: DataFrame, store: str) -> DataFrame:
    """One row per id that the store lacks; of several texts of an id the smallest."""
    one = df.groupBy("example_id").agg(F.min("input_to_embed").alias("input_to_embed")).filter("example_id is not null")
    if not commit_keys(df.sparkSession, store):
        return one
    return one.join(known_ids(one, store), "example_id", "left_anti")


def write_segment(vectors: DataFrame, ids: DataFrame, store: str, key: str) -> None:
    """Write the vectors by bucket and then the manifest of their (stored) ids, which makes them count."""
    spark = vectors.sparkSession
    segment = uuid.uuid4().hex
    rows = vectors.select("example_id", "embedding", bucket_of().alias("bucket"))
    data = f"{store}/data/{segment}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(data)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            buckets, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(buckets).tolist():
                held.setdefault(b, []).append(ids[buckets == b])
        if held:
            ids = {b: np.concatenate(parts) for b, parts in held.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * len(ids)), pa.array(list(ids), pa.int32()), pa.array([len(x) for x in ids.values()]), pa.array([bloom(x) for x in ids.values()], pa.binary())],
                ["segment", "bucket", "rows", "bits"],
            )

    lines = ids.select(bucket_of().alias("bucket"), "example_id").repartition("bucket").mapInArrow(filters, MANIFEST)
    lines.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{key}")


def append(df: DataFrame, store: str, vectors_of, key: str | None = None) -> None:
    """Add vectors of the ids that the store lacks, as commit ``key``; nothing happens if that commit is there."""
    spark = df.sparkSession
    key = key or f"batch-{uuid.uuid4().hex}"
    if path_exists(spark, f"{store}/commits/{key}/_SUCCESS"):
        return
    if len(commit_keys(spark, store)) > MOST_COMMITS:
        merge_commits(spark, store)
    todo = materialize(pending_rows(df, store))
    write_segment(vectors_of(todo), todo, store, key)


def merge_commits(spark: SparkSession, store: str) -> None:
    """All segments as one. Keys of merged commits stay, so that repeated batches are still known; their data may be removed by hand."""
    keys = [k for k in commit_keys(spark, store)]
    name = f"merged-{len(keys):09d}"
    # first what it replaces, then the commit that makes it count
    spark.createDataFrame([(k,) for k in keys], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/replaced/{name}")
    every = read_store(spark, store)
    write_segment(every, every, store, name)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """``example_id, embedding`` of all commits."""
    segments = [r["segment"] for r in manifest(spark, store).select("segment").distinct().collect()]
    if not segments:
        return spark.createDataFrame([], EMBEDDING_SCHEMA)
    paths = [f"{store}/data/{s}" for s in sorted(segments)]
    return spark.read.schema(EMBEDDING_SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)
