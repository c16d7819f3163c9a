"""Vector and batch-model queries."""

import uuid

from pyspark.sql import functions as F

from nlsql_spark.operators import model_steps as M
from nlsql_spark.operators.knn import knn
from nlsql_spark.operators.linking import link_by_embedding
from nlsql_spark.plans.jobs import generate_sql, vector_links
from nlsql_spark import constants as K
from nlsql_spark.operators.ordering import with_document_id
from nlsql_spark.session import shared_dir
from nlsql_spark.streaming.vector_store import embed_stream, read_store
from workload.inputs import CATALOG_SQL, QUESTIONS_SQL, catalog, links_text, questions, table, turns, uniform_sql
from workload.registry import query

# one query vector per label: the mean of its vectors
NEAR_SQL = """
u AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
c AS (SELECT label AS query_id, list(x::FLOAT ORDER BY i) AS v FROM m GROUP BY 1),
d AS (SELECT query_id, vec_id AS doc_id, label, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE - embedding[i]::DOUBLE) * (v[i]::DOUBLE - embedding[i]::DOUBLE))) AS distance FROM c, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM d)"""


def centroids(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy("label", "i").agg(F.avg("x").alias("x"))
    # one group is one vector
    rows = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    return rows.select(F.col("label").cast("long").alias("example_id"), F.col("r.x").cast("array<float>").alias("embedding"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("example_id"), "embedding", "label")


@query("srt_01_knn", f"WITH {NEAR_SQL} SELECT query_id::BIGINT AS query_id, doc_id, round(distance, 5) AS distance, rank::INTEGER AS rank FROM near WHERE rank <= 10")
def _(spark, sf):
    near = knn(centroids(spark, sf), vectors(spark, sf), 10)
    return near.withColumn("distance", F.round("distance", 5))


@query("srt_01_knn_blocks", f"WITH {NEAR_SQL} SELECT query_id::BIGINT AS query_id, doc_id, round(distance, 5) AS distance, rank::INTEGER AS rank FROM near WHERE rank <= 5")
def _(spark, sf):
    """The path for many queries: cells around pivots, searched as far as the k-th hit reaches."""
    near = knn(centroids(spark, sf), vectors(spark, sf), 5, block_queries=4, block_docs=128)
    return near.withColumn("distance", F.round("distance", 5))


@query("join_04_link_by_embedding", f"""
WITH {NEAR_SQL}, n AS (SELECT query_id, doc_id, 'label_' || label AS t FROM near WHERE rank <= 12),
g AS (SELECT query_id, t, min(doc_id) AS o, string_agg('vec_' || doc_id, '|' ORDER BY doc_id) AS cols FROM n GROUP BY 1, 2)
SELECT query_id::BIGINT AS question_id, string_agg(t || '(' || cols || ')', ';' ORDER BY o) AS links FROM g GROUP BY 1""")
def _(spark, sf):
    v = vectors(spark, sf)
    documents = v.select(
        F.col("example_id").alias("document_id"), F.concat(F.lit("label_"), "label").alias("table_name"),
        F.concat(F.lit("vec_"), "example_id").alias("col_name"),
    )
    return link_by_embedding(knn(centroids(spark, sf), v, 12), documents).select("question_id", links_text().alias("links"))


@query("aug_08_hash_embed", f"""
SELECT conv_id, turn, i AS dim, {uniform_sql("'0|' || md5(text) || '|' || (i - 1)")}::FLOAT AS x FROM conversations, range(1, 9) r(i)""")
def _(spark, sf):
    t = turns(spark, sf).select(F.col("question_id").alias("example_id"), F.col("question").alias("input_to_embed"))
    v = M.hash_embed(t, 8).select("example_id", F.posexplode("embedding").alias("dim", "x"))
    return v.select(
        F.floor(F.col("example_id") / 1000).alias("conv_id"), (F.col("example_id") % 1000).alias("turn"),
        (F.col("dim") + 1).cast("long").alias("dim"), "x",
    )


def _turn_texts(spark, sf):
    return turns(spark, sf).select(F.col("question_id").alias("example_id"), F.col("question").alias("input_to_embed"))


@query("udf_02_embed", f"""
WITH v AS (SELECT conv_id * 1000 + turn AS example_id, i, {uniform_sql("'0|' || md5(text) || '|' || (i - 1)")} AS x FROM conversations, range(1, 9) r(i)),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY example_id)) AS norm FROM v)
SELECT example_id, (i - 1)::INTEGER AS dim, round((x / norm)::FLOAT::DOUBLE, 4) AS x FROM n""")
def _(spark, sf):
    out = M.embed(_turn_texts(spark, sf), dim=8)
    return out.select("example_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


def text_lengths(texts):
    """A model callable: character and word counts as a vector."""
    return [[float(len(t)), float(len(t.split(" "))), 1.0] for t in texts]


@query("udf_02_embed_callable", """
SELECT conv_id * 1000 + turn AS example_id, len(text)::FLOAT AS chars, len(string_split(text, ' '))::FLOAT AS words FROM conversations""")
def _(spark, sf):
    out = M.embed(_turn_texts(spark, sf), text_lengths, normalize=False)
    return out.select("example_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("words"))


@query("udf_03_embed_incremental", "SELECT conv_id * 1000 + turn AS example_id, 4 AS dims FROM conversations")
def _(spark, sf):
    """The user turns first, then all turns (twice each) into the same store: each id once."""
    store = f"{shared_dir(spark)}/vectors-{uuid.uuid4()}"
    first = turns(spark, sf).filter("role = 'user'").select(F.col("question_id").alias("example_id"), F.col("question").alias("input_to_embed"))
    M.embed_incremental(first, store, dim=4)
    every = _turn_texts(spark, sf)
    return M.embed_incremental(every.unionByName(every), store, dim=4).select("example_id", F.size("embedding").alias("dims"))


@query("udf_01_generate_with_ledger", r"""
SELECT question_id, 'SELECT ' || reply AS response, role = 'user' AS known FROM (SELECT conv_id * 1000 + turn AS question_id, role, string_split(text, chr(10))[-1] AS reply FROM conversations)""")
def _(spark, sf):
    """The user turns are asked first; the second call, whose model says so, only asks for the others."""
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4()}"
    asked = turns(spark, sf).select(F.col("question_id").alias("id"), F.col("question").alias("prompt"), "role")
    model = lambda mark: lambda prompts: [mark + "SELECT " + p.rsplit("\n", 1)[-1] for p in prompts]
    M.generate(asked.filter("role = 'user'"), model(""), ledger=ledger).write.format("noop").mode("overwrite").save()
    out = M.generate(asked, model("new "), ledger=ledger)
    return out.select(F.col("id").alias("question_id"), F.regexp_replace("response", "^new ", "").alias("response"), (~F.startswith("response", F.lit("new "))).alias("known"))


@query("join_14_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return M.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("udf_01_generate", r"""
SELECT question_id, 'SELECT ' || reply AS response FROM (SELECT conv_id * 1000 + turn AS question_id, string_split(text, chr(10))[-1] AS reply FROM conversations)""")
def _(spark, sf):
    model = lambda prompts: ["SELECT " + p.rsplit("\n", 1)[-1] for p in prompts]
    asked = turns(spark, sf).select(F.col("question_id").alias("id"), F.col("question").alias("prompt"))
    return M.generate(asked, model).select(F.col("id").alias("question_id"), "response")


@query("agg_16_batch_by_template", f"""
WITH {QUESTIONS_SQL} SELECT difficulty AS template, count(*) AS requests, count(DISTINCT question_id) AS ids FROM questions GROUP BY 1""")
def _(spark, sf):
    q = questions(spark, sf).select(
        F.col("question_id").alias("id"), F.col("difficulty").alias("prompt_template"),
        F.create_map(F.lit("question"), F.col("question")).alias("input_mappings"),
    )
    batches = M.batch_by_template(q, batch_size=500)
    spread = batches.select(F.col("prompt_template").alias("template"), F.explode("ids").alias("id"))
    return spread.groupBy("template").agg(F.count("*").alias("requests"), F.count_distinct("id").alias("ids"))


LETTERS = "aeinorst_1"
LETTERS_SQL = "[" + ", ".join(f"len(t) - len(replace(t, '{c}', ''))" for c in LETTERS) + "]"


def letter_counts(texts):
    """A stand-in model that SQL can follow: how often each of some letters occurs."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


@query("job_04_vector_links", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
d AS (SELECT *, row_number() OVER (ORDER BY database_name, table_pos, table_name, column_pos) AS document_id, table_name || ' ' || column_name AS t FROM catalog),
dv AS (SELECT document_id, table_name, column_name, {LETTERS_SQL} AS v FROM d),
qv AS (SELECT question_id, {LETTERS_SQL} AS v FROM (SELECT question_id, '{K.QUERY_PREFIX}' || lower(question) || ' ' || lower(coalesce(knowledge, '')) AS t FROM questions)),
qu AS (SELECT DISTINCT v FROM qv),
near AS (SELECT qu.v, document_id, table_name, column_name, row_number() OVER (PARTITION BY qu.v
    ORDER BY list_sum(list_transform(list_zip(qu.v, dv.v), lambda p: (p[1] - p[2]) ** 2)), document_id) AS rank FROM qu, dv),
g AS (SELECT v, table_name, min(document_id) AS o, string_agg(column_name, '|' ORDER BY document_id) AS cols FROM near WHERE rank <= 5 GROUP BY 1, 2),
l AS (SELECT v, string_agg(table_name || '(' || cols || ')', ';' ORDER BY o) AS links FROM g GROUP BY 1)
SELECT question_id, links FROM qv JOIN l USING (v)""")
def _(spark, sf):
    numbered = with_document_id(catalog(spark, sf), ["database_name", "table_pos", "table_name", "column_pos"])
    documents = numbered.select("document_id", "table_name", F.col("column_name").alias("col_name"))
    texts = documents.select(F.col("document_id").alias("example_id"), F.concat_ws(" ", "table_name", "col_name").alias("input_to_embed"))
    return vector_links(questions(spark, sf), documents, texts, 5, letter_counts, normalize=False).select("question_id", links_text().alias("links"))


@query("job_09_generate_sql", f"""
WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN difficulty = 'simple' THEN 'SELECT 1' ELSE replace(sql_query, '>', '> ') END AS sql FROM questions""")
def _(spark, sf):
    """Model replies: a query with a stray newline; for simple questions the reply only sits in an error text."""
    q = questions(spark, sf)
    prompts = q.select("question_id", F.concat_ws("\n", "difficulty", "sql_query").alias("prompt"))

    def model(asked):
        if len(asked) == 1 and asked[0].startswith("simple"):
            raise ValueError('not json: {"sql": "SELECT\n1"} ')
        if any(p.startswith("simple") for p in asked):
            raise ValueError("mixed batch")
        return [p.split("\n", 1)[1].replace("> ", ">\n ") for p in asked]

    return generate_sql(prompts, model, max_retries=0).select("question_id", "sql")


@query("job_13_vector_store", "SELECT conv_id * 1000 + turn AS example_id, 4 AS dims FROM conversations")
def _(spark, sf):
    """Texts arriving as files, embedded by the stream into the store."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    texts = _turn_texts(spark, sf)
    texts.write.parquet(f"{base}/in")
    texts.write.mode("append").parquet(f"{base}/in")
    embed_stream(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint", max_files=1, dim=4).awaitTermination()
    return read_store(spark, f"{base}/store").select("example_id", F.size("embedding").alias("dims"))
