"""op4: near-duplicate classes of all ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from llm.neardup import near_duplicates
from llm.registry import query


@query("op4_minmax_near_duplicates")
def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85, bands=32, rows=6)
