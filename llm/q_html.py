"""op11: the main text of all ``pages``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.extract import extract_text
from llm.registry import query


@query("op11_html_main_text")
def op11_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
