"""Incremental vector store over an arriving file folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nlsql_spark.operators.model_steps import EmbedFn, embed
from nlsql_spark.sources import keyed_store
from nlsql_spark.sources.keyed_store import read_store  # noqa: F401  the store's reader

TEXT_SCHEMA = "example_id bigint, input_to_embed string"


def embed_stream(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    fn: EmbedFn | None = None,
    fmt: str = "parquet",
    max_files: int = 1_000,
    **options,
) -> StreamingQuery:
    """Embed new texts of ``source`` into the keyed store, each id once; ends when all files are read.

    The checkpoint remembers the files, the store's filters which ids are done, so no state grows. A micro-batch is one
    commit, named STREAM-N by the id in the checkpoint; a repeated batch finds its commit or writes it whole, and a
    stream with a new checkpoint adds to the store.
    """
    texts = spark.readStream.schema(TEXT_SCHEMA).format(fmt).option("maxFilesPerTrigger", max_files).load(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        keyed_store.append(batch, store, lambda todo: embed(todo, fn, **options), f"{stream}-{batch_id:09d}")

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
