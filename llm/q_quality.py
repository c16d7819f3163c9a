"""op5: quality counts and verdict of every whole text of ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from llm.common import spread, stored
from llm.quality import common_words, judge, measure, references
from llm.registry import query


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # the texts are not stored again: only ids, languages and counts go on
    common = common_words(spread(docs))
    measured = stored(measure(spread(docs), common).drop("text"))
    return judge(measured, references(measured, common)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )
