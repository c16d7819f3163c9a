"""Source and sink queries (write and read back in the shared folder), column profiles, documents."""

import uuid

from pyspark.sql import functions as F

from nlsql_spark.operators import catalog as C
from nlsql_spark.operators import ordering as O
from nlsql_spark.operators import profile as P
from nlsql_spark.plans.jobs import retrieval_documents
from nlsql_spark.session import shared_dir
from nlsql_spark.sources import files as S
from nlsql_spark.sources import writers as W
from nlsql_spark.sources.json_array import read_written_array, write_json_array
from workload.inputs import CATALOG_SQL, QUESTIONS_SQL, SUBSTRING_SQL, catalog, links_text, questions, stored_questions, table
from workload.q_text import SAMPLES_SQL, samples
from workload.registry import query


def _folder(spark):
    return f"{shared_dir(spark)}/files-{uuid.uuid4()}"


def _entries(spark, sf):
    """Benchmark entries as JSON text: train, dev and step variants, and some with a stray or missing field."""
    q = questions(spark, sf)
    base = [F.col("database_name").alias("db_id"), F.col("question"), F.coalesce("knowledge", F.lit("")).alias("evidence"), F.col("sql_query").alias("SQL")]
    text = lambda *extra: F.to_json(F.struct(*base, *extra))
    entry = (
        F.when(F.col("first_line") == 1, text())
        .when(F.col("first_line") == 2, text(F.col("question_id"), F.col("difficulty")))
        .when(F.col("first_line") == 3, text(F.col("reasoning_steps")))
        .when(F.col("first_line") == 4, text(F.lit("x").alias("note")))
        .otherwise(F.to_json(F.struct(*base[:3])))
    )
    return q.select("question_id", entry.alias("entry"))


@query("src_03_validate_entries", f"""
WITH {QUESTIONS_SQL} SELECT question_id, CASE first_line WHEN 1 THEN 'train' WHEN 2 THEN 'dev' WHEN 3 THEN 'train_with_steps' ELSE 'reject' END AS variant FROM questions""")
def _(spark, sf):
    good, rejects = S.validate_entries(_entries(spark, sf))
    return good.select("question_id", "variant").unionByName(rejects.select("question_id", F.lit("reject").alias("variant")))


@query("src_01_read_questions", f"""
WITH {QUESTIONS_SQL} SELECT question_id, database_name, question, sql_query, coalesce(knowledge, '') AS knowledge, difficulty FROM questions""")
def _(spark, sf):
    """Dev entries written as question-set files, each one JSON array of bounded size, and read back."""
    folder = _folder(spark)
    fields = [
        F.col("database_name").alias("db_id"), F.col("question"), F.coalesce("knowledge", F.lit("")).alias("evidence"),
        F.col("sql_query").alias("SQL"), F.col("question_id"), F.col("difficulty"),
    ]
    entries = stored_questions(spark, sf).select("question_id", F.to_json(F.struct(*fields)).alias("entry"))
    arrays = O.chunk(entries, "question_id", 5_000).groupBy("chunk").agg(F.collect_list("entry").alias("e"))
    text = F.concat(F.lit("["), F.array_join("e", ","), F.lit("]"))
    arrays.select("chunk", text.alias("value")).write.partitionBy("chunk").text(folder)
    back = S.read_questions(spark, f"{folder}/*")
    return back.select("question_id", "database_name", "question", "sql_query", "knowledge", "difficulty")


@query("src_04_read_jsonl", f"WITH {QUESTIONS_SQL} SELECT question_id, question, knowledge, array_to_string(reasoning_steps, '|') AS steps FROM questions")
def _(spark, sf):
    folder = _folder(spark)
    W.write_jsonl(questions(spark, sf).select("question_id", "question", "knowledge", "reasoning_steps"), folder)
    back = S.read_jsonl(spark, folder, "question_id long, question string, knowledge string, reasoning_steps array<string>")
    return back.select("question_id", "question", "knowledge", F.array_join("reasoning_steps", "|").alias("steps"))


@query("src_06_read_column_descriptions", """
SELECT DISTINCT lower(p_type) AS table_name, lower(p_name) AS original_column_name, 'first line' || chr(10) || '"' || lower(p_name) || '"' AS column_description,
    'integer' AS data_format FROM part""")
def _(spark, sf):
    """Part names as described columns of their type, with repeated rows, quotes, blanks and line breaks."""
    folder = _folder(spark)
    rows = table(spark, sf, "part").select(
        F.lower("p_type").alias("t"), F.initcap("p_name").alias("original_column_name"), F.lit("x").alias("column_name"),
        F.concat(F.lit(" First line\n\""), "p_name", F.lit("\" ")).alias("column_description"), F.lit("INTEGER ").alias("data_format"),
        F.lit("").alias("value_description"),
    )
    rows.repartition("t").write.partitionBy("t").option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    back = S.read_column_descriptions(spark, f"{folder}/*", "parts", table_from=r"/t=([^/]+)/")
    return back.select("table_name", "original_column_name", "column_description", "data_format")


@query("src_07_scan", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top_price FROM orders GROUP BY 1")
def _(spark, sf):
    orders = S.Registry({"shop": sf}).scan(spark, "shop", "orders", ["o_orderstatus", "o_totalprice"])
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top_price"))


@query("src_10_read_predictions", f"WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN knowledge IS NULL THEN '' ELSE sql_query END AS sql FROM questions")
def _(spark, sf):
    """Responses written by the prediction writer; questions without knowledge have a NULL response."""
    folder = _folder(spark)
    q = questions(spark, sf)
    W.write_predictions(
        q.select(
            F.struct(F.col("question_id").cast("string").alias("id")).alias("input_data"),
            F.when(F.col("knowledge").isNotNull(), F.struct(F.col("sql_query").alias("sql"))).alias("response"),
            F.lit(None).cast("string").alias("error"),
        ),
        folder,
    )
    return S.read_predictions(spark, folder)


@query("snk_03_prediction_rows", f"WITH {QUESTIONS_SQL} SELECT question_id, coalesce(knowledge, 'None') AS error FROM questions")
def _(spark, sf):
    folder = _folder(spark)
    W.write_predictions(questions(spark, sf).select("question_id", F.col("knowledge").alias("error")), folder)
    return S.read_jsonl(spark, folder, "question_id long, error string")


LINKS_SQL = """
SELECT q.question_id, coalesce(string_agg(sl.table_name || '(' || array_to_string(sl.columns, '|') || ')', ';' ORDER BY sl.table_pos), '') AS links
FROM questions q LEFT JOIN sl USING (question_id) GROUP BY q.question_id"""


@query("src_11_read_links", f"WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL} {LINKS_SQL}")
def _(spark, sf):
    folder = _folder(spark)
    W.write_ground_truth_links(questions(spark, sf), catalog(spark, sf), folder)
    return S.read_links(spark, folder).select("question_id", links_text().alias("links"))


@query("src_12_read_training_samples", f"WITH {QUESTIONS_SQL}, {SAMPLES_SQL} SELECT question_id, p AS prompt, sql_query AS query, question FROM samples ORDER BY question_id LIMIT 100")
def _(spark, sf):
    folder = _folder(spark)
    W.write_jsonl(samples(spark, sf), folder)
    return S.read_training_samples(spark, folder, limit=100).select("question_id", "prompt", "query", "question")


@query("src_13_read_embeddings", "SELECT vec_id AS example_id, len(embedding)::INTEGER AS dims, embedding[1] AS first_value FROM embeddings")
def _(spark, sf):
    folder = _folder(spark)
    W.write_embeddings(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "example_id"), folder)
    e = S.read_embeddings(spark, folder)
    return e.select("example_id", F.size("embedding").alias("dims"), F.col("embedding")[0].alias("first_value"))


@query("snk_02_enriched_entries", f"""
WITH {QUESTIONS_SQL} SELECT row_number() OVER (ORDER BY question_id) - 1 AS pos, database_name AS db_id, question, sql_query AS "SQL",
    len(reasoning_steps)::INTEGER AS n, array_to_string(reasoning_steps, '|') AS steps FROM questions""")
def _(spark, sf):
    """One JSON array in parts, read back in the order of the ids."""
    folder = _folder(spark)
    W.write_enriched_entries(questions(spark, sf), folder)
    back = read_written_array(spark, folder).select("pos", F.from_json("entry", S.ENTRY_SCHEMA).alias("e")).select("pos", "e.*")
    return back.select("pos", "db_id", "question", "SQL", F.size("reasoning_steps").alias("n"), F.array_join("reasoning_steps", "|").alias("steps"))


@query("src_01_read_one_array", f"""
WITH {QUESTIONS_SQL} SELECT row_number() OVER (ORDER BY question_id) - 1 AS pos, question_id, question, sql_query FROM questions""")
def _(spark, sf):
    """All entries as one array file, in which elements have line breaks, braces and quotes, read by ranges."""
    folder = _folder(spark)
    q = questions(spark, sf).select("question_id", "question", "sql_query", F.lit('\\"}],{[ \\\\').alias("odd"))
    write_json_array(q.select("question_id", F.to_json(F.struct("question_id", "question", "sql_query", "odd"), {"pretty": "true"}).alias("entry")), folder, ["question_id"])
    back = read_written_array(spark, folder).select("pos", F.from_json("entry", "question_id long, question string, sql_query string").alias("e"))
    return back.select("pos", "e.*")


@query("snk_05_run_results", f"WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, l AS ({LINKS_SQL}) SELECT question_id, sql_query AS response, 'None' AS error, links FROM questions JOIN l USING (question_id)")
def _(spark, sf):
    from nlsql_spark.operators.linking import link_by_substring

    folder = _folder(spark)
    q = questions(spark, sf)
    sql = q.select("question_id", F.col("sql_query").alias("response"), F.lit(None).cast("string").alias("error"))
    W.write_run_results(link_by_substring(q, catalog(spark, sf)), sql, folder)
    answers = S.read_jsonl(spark, f"{folder}/sql_generation", "question_id long, response string, error string")
    links = S.read_links(spark, f"{folder}/schema_linking").select("question_id", links_text().alias("links"))
    return answers.join(links, "question_id")


ORDER_FORMATS = {"o_orderkey": "integer", "o_totalprice": "real", "o_orderstatus": "text", "o_orderpriority": "text"}
EVENT_FORMATS = {"event_id": "integer", "value": "real", "event_type": "text", "props": "text"}


def _cells_sql(source: str, cols: list[str], pos: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, {pos} AS pos FROM {source}" for c in cols)


@query("agg_02_distinct_values", f"""
SELECT DISTINCT column_name, value FROM (SELECT 'c_nationkey' AS column_name, c_nationkey::VARCHAR AS value FROM customer
UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'segment', CASE WHEN c_acctbal > 0 THEN c_mktsegment END FROM customer)""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("segment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return P.distinct_values(c, ["c_nationkey", "c_name", "segment"])


@query("agg_03_column_range", """
SELECT 'l_quantity' AS column_name, min(l_quantity)::VARCHAR AS min_value, max(l_quantity)::VARCHAR AS max_value FROM lineitem
UNION ALL SELECT 'l_linenumber', min(l_linenumber)::VARCHAR, max(l_linenumber)::VARCHAR FROM lineitem
UNION ALL SELECT 'l_shipdate', min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR FROM lineitem""")
def _(spark, sf):
    return P.column_range(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber", "l_shipdate"])


def top_sql(source: str, cols: list[str], pos: str) -> str:
    return f"""
cells AS ({_cells_sql(source, cols, pos)}),
tc AS (SELECT column_name, value, count(*) AS n, min(pos) AS first_pos FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, first_pos, value) AS rank FROM tc)"""


@query("agg_04_top_values", f"WITH {top_sql('events', ['event_type', 'user_id', 'props'], 'event_id')} SELECT column_name, value, n, first_pos, rank::INTEGER AS rank FROM top WHERE rank <= 3")
def _(spark, sf):
    return P.top_values(table(spark, sf, "events"), ["event_type", "user_id", "props"], "event_id")


@query("agg_04_top_values_two_pass", f"WITH {top_sql('events', ['event_type', 'user_id', 'props', 'event_id'], 'event_id')} SELECT column_name, value, n, first_pos, rank::INTEGER AS rank FROM top WHERE rank <= 3")
def _(spark, sf):
    """As for a large table: a few types (summaries), users and props (little repeated), and a key without repeats (by hash)."""
    return P.top_values(table(spark, sf, "events"), ["event_type", "user_id", "props", "event_id"], "event_id", capacity=256, direct_bytes=0)


def _shop(spark, sf):
    return {"orders": table(spark, sf, "orders"), "events": table(spark, sf, "events")}


KEY_ROWS = [("shop", "orders", 0, "pk", 0, "o_orderkey", None, None), ("shop", "events", 0, "pk", 0, "event_id", None, None)]
COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
           "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


def _shop_catalog(spark, sf):
    return C.introspect(spark, _shop(spark, sf), "shop", spark.createDataFrame(KEY_ROWS, C.KEYS_SCHEMA))


def _shop_descriptions(spark, sf):
    return _shop_catalog(spark, sf).select(
        "database_name", "table_name", F.col("column_name").alias("original_column_name"),
        F.concat(F.lit("Column "), "column_name").alias("column_description"),
        F.when(F.col("data_format") == "string", "text").when(F.col("data_format") == "double", "real")
        .when(F.col("data_format").startswith("timestamp"), "datetime").otherwise("integer").alias("data_format"),
    )


@query("src_08_introspect", """
SELECT table_name, column_name, pos::INTEGER AS column_pos, pos = 0 AS is_primary_key, n FROM (
    SELECT 'orders' AS table_name, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name, unnest(range(6)) AS pos, (SELECT count(*) FROM orders) AS n
    UNION ALL SELECT 'events', unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']), unnest(range(6)), (SELECT count(*) FROM events))""")
def _(spark, sf):
    """Columns of two tables with keys flagged, and the row count of their table."""
    counts = [df.agg(F.count("*").alias("n")).withColumn("table_name", F.lit(t)) for t, df in _shop(spark, sf).items()]
    return _shop_catalog(spark, sf).join(O.union_all(counts), "table_name").select("table_name", "column_name", "column_pos", "is_primary_key", "n")


PROFILE_SQL = f"""
{top_sql('orders', ['o_orderstatus', 'o_orderpriority'], 'o_orderkey')},
{top_sql('events', ['event_type', 'props'], 'event_id').replace('cells', 'ecells').replace('tc AS', 'etc AS').replace('FROM tc', 'FROM etc').replace('top AS', 'etop AS')},
vals AS (
SELECT 'orders' AS vt, column_name, lower(string_agg(value, ' ' ORDER BY rank)) AS v FROM top WHERE rank <= 3 GROUP BY 1, 2
UNION ALL SELECT 'events', column_name, lower(string_agg(value, ' ' ORDER BY rank)) FROM etop WHERE rank <= 3 GROUP BY 1, 2
UNION ALL SELECT 'orders', 'o_orderkey', min(o_orderkey) || ' ' || max(o_orderkey) FROM orders
UNION ALL SELECT 'orders', 'o_totalprice', min(o_totalprice) || ' ' || max(o_totalprice) FROM orders
UNION ALL SELECT 'events', 'event_id', min(event_id) || ' ' || max(event_id) FROM events
UNION ALL SELECT 'events', 'value', min(value) || ' ' || max(value) FROM events),
cols AS (SELECT 'orders' AS t, 0 AS tp, unnest({COLUMNS['orders']}) AS c, unnest(range(6)) AS cp, unnest(['integer', 'integer', 'text', 'real', 'datetime', 'text']) AS f
    UNION ALL SELECT 'events', 1, unnest({COLUMNS['events']}), unnest(range(6)), unnest(['integer', 'datetime', 'integer', 'text', 'real', 'text'])),
docs AS (SELECT row_number() OVER (ORDER BY tp, cp) - 1 AS document_id, t, c, cp, f, v FROM cols LEFT JOIN vals ON vals.vt = cols.t AND vals.column_name = cols.c)"""


def _profiles(spark, sf):
    shop = _shop(spark, sf)
    return {"orders": (shop["orders"], ORDER_FORMATS, "o_orderkey"), "events": (shop["events"], EVENT_FORMATS, "event_id")}


@query("join_08_build_documents", f"WITH {PROFILE_SQL} SELECT document_id, t AS table_name, c AS col_name, f AS col_data_format, cp = 0 AS is_primary_key, v AS values_text FROM docs")
def _(spark, sf):
    values = O.union_all([P.column_profiles(df, "shop", name, formats, order) for name, (df, formats, order) in _profiles(spark, sf).items()])
    docs = P.build_documents(_shop_catalog(spark, sf), _shop_descriptions(spark, sf), values)
    return docs.select("document_id", "table_name", "col_name", "col_data_format", "is_primary_key", "values_text")


@query("job_01_retrieval_documents", f"""
WITH {PROFILE_SQL} SELECT document_id AS example_id, t || ' ' || c || ' column ' || c || ' ' || f || ' ' || coalesce(v, '') AS input_to_embed FROM docs WHERE cp > 0""")
def _(spark, sf):
    return retrieval_documents(_shop_catalog(spark, sf), _shop_descriptions(spark, sf), _profiles(spark, sf), "shop", numeric_keys=True)


@query("job_01_retrieval_documents_uuid", f"""
WITH {PROFILE_SQL} SELECT document_id AS example_id, t || ' ' || c || ' column ' || c || ' ' || f || ' ' || coalesce(v, '') AS input_to_embed FROM docs WHERE NOT (t = 'orders' AND cp = 0)""")
def _(spark, sf):
    """Orders under keys that look like a UUID, which the rule drops; the keys of events are numbers and stay."""
    profiles = _profiles(spark, sf)
    orders, formats, _ = profiles["orders"]
    code = F.md5(F.col("o_orderkey").cast("string"))
    uid = F.concat(F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 4), F.lit("-4"), F.substring(code, 13, 3), F.lit("-8"), F.substring(code, 16, 3), F.lit("-"), F.substring(code, 19, 12))
    keyed = orders.withColumn("place", F.col("o_orderkey")).withColumn("o_orderkey", uid)
    profiles["orders"] = (keyed, {c: f for c, f in formats.items() if c != "o_orderkey"}, "place")
    return retrieval_documents(_shop_catalog(spark, sf), _shop_descriptions(spark, sf), profiles, "shop", uuid_keys=True)


@query("snk_06_retrieval_dataset", f"""
WITH {QUESTIONS_SQL},
cols AS (SELECT 'orders' AS t, 0 AS tp, column_name AS c, row_number() OVER () AS cp FROM (DESCRIBE orders)
    UNION ALL SELECT 'events', 1, column_name, row_number() OVER () FROM (DESCRIBE events))
SELECT 'queries' AS part, question_id::VARCHAR AS key, md5(question || '|' || coalesce(knowledge, '')) AS content FROM questions
UNION ALL SELECT 'documents', (row_number() OVER (ORDER BY tp, cp) - 1)::VARCHAR, md5(t || '|' || c || '|Column ' || c) FROM cols
UNION ALL SELECT DISTINCT 'document_values', 'o_orderstatus', md5(o_orderstatus) FROM orders
UNION ALL SELECT DISTINCT 'document_values', 'o_custkey', md5(o_custkey::VARCHAR) FROM orders""")
def _(spark, sf):
    folder = _folder(spark)
    empty = spark.createDataFrame([], "database_name string, table_name string, column_name string, values_text string")
    docs = P.build_documents(_shop_catalog(spark, sf), _shop_descriptions(spark, sf), empty)
    W.dump_retrieval_dataset(questions(spark, sf), docs, P.distinct_values(_shop(spark, sf)["orders"], ["o_orderstatus", "o_custkey"]), folder)
    read = lambda part, schema, key, *content: S.read_jsonl(spark, f"{folder}/{part}", schema).select(
        F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in content])).alias("content")
    )
    return O.union_all([
        read("queries", "question_id long, question string, external_knowledge string", "question_id", "question", "external_knowledge"),
        read("documents", "document_id long, table_name string, col_name string, col_description string", "document_id", "table_name", "col_name", "col_description"),
        read("document_values", "column_name string, value string", "column_name", "value"),
    ])


@query("srt_02_sort_by_int_id", "SELECT o_orderkey::VARCHAR AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def _(spark, sf):
    """Text ids in numeric order: the place of each in the file that the sorted table is written to."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return _written_places(spark, O.sort_by_int_id(ids, "id"), "id")


def _written_places(spark, df, *cols):
    """The rows as they stand in files: by name of the file, and in it by row."""
    folder = _folder(spark)
    df.write.parquet(folder)
    rows = spark.read.parquet(folder).select(*cols, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return O.ordered_position(rows, ["file", "row"], name="place").select(*cols, "place")


@query("srt_03_sort_by_question", f"WITH {QUESTIONS_SQL} SELECT question_id, difficulty, row_number() OVER (ORDER BY question_id) - 1 AS place FROM questions")
def _(spark, sf):
    return _written_places(spark, O.sort_by_question(questions(spark, sf)).select("question_id", "difficulty"), "question_id", "difficulty")


@query("srt_05_head", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("size"))
    return O.head(d, 20, "size", "doc_id").select("doc_id", "source")


@query("set_05_union_all", """
SELECT doc_id AS id, 'documents' AS kind FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark""")
def _(spark, sf):
    part = lambda name, key: table(spark, sf, name).select(F.col(key).alias("id"), F.lit(name).alias("kind"))
    return O.union_all([part("documents", "doc_id"), part("pages", "page_id"), part("benchmark", "item_id")])
