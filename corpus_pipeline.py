"""The corpus pipeline: language identification, line deduplication, near-duplicate removal, benchmark
decontamination and packing, each stage written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Rows with null or empty texts, repeated rows and extra columns are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stored
from llm.decontam import drop_contaminated
from llm.langid import identify, train
from llm.linededup import dedup_lines
from llm.neardup import drop_near_duplicates
from llm.packing import pack, token_pieces

CAPACITY, END_ID = 1024, 2


#: Rows of a batch between Spark and Python: whole texts travel in them, twice in the JVM and once in the worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def plain(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[f"`{c}`" for c in like.columns])


#: A language is rejected below this score. The score is the share of the family times the share of the language in it, so a
#: text that neither level can decide has about a quarter or less; the lowest score of a text with two words is 0.5 on sf0.1.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language at all (null, or without a letter) go, and texts that no language wins; a null ``lang`` becomes the
    predicted one. Where no row has a language there is nothing to predict with, and every text with a letter stays."""
    small_batches(spark)
    model = train(docs, F.lit(True))
    found = identify(docs, model)
    if not model.langs:
        return plain(found.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), docs)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return plain(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are taken out of the texts; a document of which no word is left goes (it was a copy)."""
    small_batches(spark)
    found = dedup_lines(docs)
    return plain(found.filter((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens."""
    small_batches(spark)
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    return pack(pieces, CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: The classifier, the signatures and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
