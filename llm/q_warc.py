"""op9: all ``pages`` written as WARC archives, read back and assembled."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stored
from llm.registry import query
from llm.warc import assemble, plan_captures, read_records, write_warc


@query("op9_warc_transactions")
def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    # stored, as the three kinds of records are joined; the payloads were checked when they were read
    records = stored(read_records(spark, write_warc(plan_captures(pages, min_bytes=0)), with_payload=False))
    captures = assemble(records)
    page = F.expr("try_cast(metadata.fields['page-id'] as bigint)")
    flat = captures.select(
        "capture_id", page.alias("page_id"), F.coalesce("response.payload_bytes", F.expr("cast(metadata.fields['payload-bytes'] as bigint)")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_id"),
    )
    owners = flat.filter(F.col("record_type") == "response").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return flat.join(owners, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
