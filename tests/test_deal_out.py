"""Work that costs processor time is dealt to all cores, however few partitions its rows come in."""

from nlsql_spark.operators.retry import build_retry_dataset


def test_retry_dataset_is_made_by_all_cores(spark):
    catalog = spark.createDataFrame(
        [("d", "t", 1, c, i, "text", None, False, False, False) for i, c in enumerate(("a", "b"))],
        "database_name string, table_name string, table_pos long, column_name string, column_pos long, data_format string,"
        " default_value string, is_not_null boolean, is_primary_key boolean, is_foreign_key boolean",
    )
    rows = [(i, "d", "q", "SELECT a FROM t", None, ["one", "two"]) for i in range(400)]
    schema = "question_id long, database_name string, question string, sql_query string, knowledge string, reasoning_steps array<string>"
    out = build_retry_dataset(spark.createDataFrame(rows, schema).coalesce(1), catalog, copies=2)
    sizes = [n for n in out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 800 and len(sizes) >= spark.sparkContext.defaultParallelism
