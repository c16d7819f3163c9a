"""Writers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlsql_spark.operators.linking import link_by_substring
from nlsql_spark.sources.json_array import write_json_array


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines, NULL fields kept. ``single_file`` is for small results only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_enriched_entries(df: DataFrame, path: str) -> None:
    """Entries with their steps, under the names of the question-set files, as one JSON array by id (``read_written_array``)."""
    entry = F.struct(
        F.col("database_name").alias("db_id"), F.col("question"), F.col("knowledge").alias("evidence"),
        F.col("sql_query").alias("SQL"), F.col("reasoning_steps"),
    )
    text = F.to_json(entry, {"ignoreNullFields": "false"})
    write_json_array(df.select("question_id", text.alias("entry")), path, ["question_id"])


def prediction_rows(df: DataFrame) -> DataFrame:
    """Error as text ('None' if there is none), the other fields as they are."""
    return df.withColumn("error", F.coalesce(F.col("error").cast("string"), F.lit("None")))


def write_predictions(df: DataFrame, path: str) -> None:
    write_jsonl(prediction_rows(df), path)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("example_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_run_results(links: DataFrame | None, sql: DataFrame, path: str) -> None:
    """Query responses, and the links if there are any, as two outputs."""
    write_predictions(sql, f"{path}/sql_generation")
    if links is not None:
        write_jsonl(links, f"{path}/schema_linking")


def dump_retrieval_dataset(questions: DataFrame, documents: DataFrame, values: DataFrame, path: str) -> None:
    """Queries, documents and the documents' distinct values (one row each) for retrieval.

    The values of a column are rows of their own table, not one list: a column may have billions.
    """
    queries = questions.select("question_id", "question", F.col("knowledge").alias("external_knowledge"))
    write_jsonl(queries, f"{path}/queries")
    write_jsonl(documents, f"{path}/documents")
    write_jsonl(values, f"{path}/document_values")


def write_ground_truth_links(questions: DataFrame, catalog: DataFrame, path: str) -> None:
    write_jsonl(link_by_substring(questions, catalog), path)
