"""op8: byte strings of 50 that also start in a document with a smaller id, for all ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.registry import query
from llm.repeats import remove_repeats


@query("op8_repeated_bytes")
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, 50).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
