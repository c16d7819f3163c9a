"""op3 and op10: token files and packed sequences of all ``documents``."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm.packing import pack, token_pieces
from llm.registry import query
from llm.tokenfile import read_tokens, write_tokens

END_ID = 2


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tokens(spark, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, END_ID)
    return pack(pieces, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
