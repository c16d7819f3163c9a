"""op12: all ``embeddings`` whitened on their first 16 components."""

from pyspark.sql import DataFrame, SparkSession

from llm.registry import query
from llm.whitening import by_component, whiten


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 16))
