"""op1: the language of every whole text of ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.langid import identify, train
from llm.registry import query


def held_out():
    """True where crc32 of the id as text leaves 1 when divided by 3; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
