"""Session helpers: defaults, the shared checkpoint folder, size-checked broadcast."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (in rows) that is ever hinted for broadcast; above it Spark plans a shuffle join.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nlsql_spark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rows here cost processor time rather than bytes: keep all local cores busy on small data
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local run without one gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="nlsql-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that later passes see the very same rows and partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the shared folder, as Parquet."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a scan that is one single task (a small file) before work that costs processor time."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if cores > 1 and scan.rdd.getNumPartitions() == 1 else scan


def deal_out(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, for work that costs processor time: Spark joins tasks by their bytes, which for such rows leaves few."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows to learn whether a table may be broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, measure: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only after a row count; ``measure`` is the flat table behind a nested one."""
    return F.broadcast(df) if is_small(df if measure is None else measure, max_rows) else df
