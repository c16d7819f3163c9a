"""op7: fuzzy line deduplication of all ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.linededup import dedup_lines
from llm.registry import query


@query("op7_fuzzy_lines")
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select(
        "doc_id",
        "n_lines_removed",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
