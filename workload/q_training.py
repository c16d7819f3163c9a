"""Training-table queries: positions, chunks, vocabulary, ids, padded batches."""

from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.operators import ordering as O
from nlsql_spark.operators import training_tables as TT
from nlsql_spark.plans.jobs import training_batches
from workload.inputs import CATALOG_SQL, QUESTIONS_SQL, catalog, questions, table
from workload.q_text import PAIR_SQL, SAMPLES_SQL, lit_sql, samples
from workload.registry import query

N_SPECIAL = len(K.SPECIAL_TOKENS)
BOS, EOS, UNK = (K.SPECIAL_TOKENS.index(t) for t in (K.BOS, K.EOS, K.UNK))
SPECIAL_VALUES = ", ".join(f"({lit_sql(t)}, {i})" for i, t in enumerate(K.SPECIAL_TOKENS))


def words_sql(text: str) -> str:
    for token in K.SPECIAL_TOKENS:
        text = f"replace({text}, {lit_sql(token)}, ' ' || {lit_sql(token)} || ' ')"
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def vocab_sql(source: str, text: str) -> str:
    return f"""
vt AS (SELECT unnest({words_sql(text)}) AS token FROM {source}),
vc AS (SELECT token, count(*) AS n FROM vt WHERE token NOT IN (SELECT s.token FROM (VALUES {SPECIAL_VALUES}) s(token, id)) GROUP BY 1),
vocab AS (SELECT token, ({N_SPECIAL} + row_number() OVER (ORDER BY n DESC, token) - 1)::INTEGER AS id FROM vc UNION ALL SELECT * FROM (VALUES {SPECIAL_VALUES}) s(token, id))"""


def encode_sql(source: str, key: str, text: str, out: str) -> str:
    return f"""
{out}_w AS (SELECT {key}, {words_sql(text)} AS w FROM {source}),
{out}_t AS (SELECT {key}, unnest(w) AS token, unnest(range(len(w))) AS pos FROM {out}_w),
{out} AS (SELECT {key}, list(coalesce(v.id, {UNK})::INTEGER ORDER BY pos) AS ids FROM {out}_t LEFT JOIN vocab v USING (token) GROUP BY 1)"""


ids_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


@query("src_02_number_rows", """
SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS question_id FROM documents""")
def _(spark, sf):
    from nlsql_spark.sources.files import number_lines

    d = table(spark, sf, "documents").select("doc_id", "source")
    return number_lines(d, ["source", "doc_id"]).select("doc_id", "question_id")


@query("src_02_with_position", f"""
WITH {QUESTIONS_SQL} SELECT question_id, unnest(range(len(reasoning_steps)))::INTEGER AS pos, unnest(reasoning_steps) AS step FROM questions""")
def _(spark, sf):
    from nlsql_spark.sources.files import with_position

    q = questions(spark, sf).select("question_id", F.col("reasoning_steps").alias("step"))
    return with_position(q, "step", "pos")


@query("win_02_document_id", f"""
WITH {CATALOG_SQL}
SELECT database_name, table_name, column_name, row_number() OVER (ORDER BY database_name, table_pos, table_name, column_pos) - 1 AS document_id FROM catalog""")
def _(spark, sf):
    c = catalog(spark, sf).select("database_name", "table_pos", "table_name", "column_pos", "column_name")
    return O.with_document_id(c, ["database_name", "table_pos", "table_name", "column_pos"]).select(
        "database_name", "table_name", "column_name", "document_id"
    )


@query("win_02_ordered_position_ranges", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position FROM events""")
def _(spark, sf):
    """The range-partitioned path: positions within an event type, cut into ranges of 2 000 rows."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return O.ordered_position(e, ["ts", "event_id"], ["event_type"], rows_per_range=2_000).select("event_id", "position")


@query("win_05_chunk", "SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100)::BIGINT AS chunk FROM orders")
def _(spark, sf):
    return O.chunk(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("udf_04_build_vocab", f"WITH {vocab_sql('documents', 'text')} SELECT token, id FROM vocab")
def _(spark, sf):
    return TT.build_vocab(table(spark, sf, "documents"))


@query("udf_04_encode", f"""
WITH {vocab_sql('documents', 'text')}, {encode_sql('documents', 'doc_id', 'text', 'coded')}
SELECT doc_id, len(ids)::INTEGER AS n_ids, md5(array_to_string(ids, ',')) AS ids FROM coded""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    coded = TT.encode(d, TT.build_vocab(d), ["doc_id"])
    return coded.select("doc_id", F.size("ids").alias("n_ids"), F.md5(ids_text("ids")).alias("ids"))


CORPUS_SQL = """
corpus AS (SELECT concat_ws(' ', p, question, array_to_string(reasoning_steps, ' '), sql_query) AS text FROM samples)"""
TRAIN_TEXT = """CASE WHEN question IS NOT NULL THEN '[CONTEXT] ' || p || '[QUESTION] ' || question || chr(10) || '[REASONING] '
    || array_to_string(reasoning_steps, ' ') || ' [SQL] ' || sql_query ELSE p || ' ' || sql_query END"""
CHAT_SQL = """
chat AS (SELECT question_id, '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS source, answer FROM pairs)"""


def corpus():
    return F.concat_ws(" ", "prompt", "question", F.array_join("reasoning_steps", " "), "query")


@query("udf_05_tokenized_pretraining", f"""
WITH {QUESTIONS_SQL}, {SAMPLES_SQL}, {CORPUS_SQL}, {vocab_sql('corpus', 'text')},
t AS (SELECT question_id, {TRAIN_TEXT} AS text FROM samples), {encode_sql('t', 'question_id', 'text', 'coded')}
SELECT question_id, array_to_string(list_concat([{BOS}], ids, [{EOS}]), ',') AS input_ids, (len(ids) + 2)::INTEGER AS attended FROM coded""")
def _(spark, sf):
    s = samples(spark, sf)
    out = TT.tokenized_dataset(s, TT.build_vocab(s.select(corpus().alias("text"))), "pretraining")
    return out.select("question_id", ids_text("input_ids").alias("input_ids"), F.size("attention_mask").alias("attended"))


@query("udf_05_tokenized_instruction", f"""
WITH {QUESTIONS_SQL}, {SAMPLES_SQL}, {CORPUS_SQL}, {vocab_sql('corpus', 'text')}, {PAIR_SQL}, {CHAT_SQL},
f AS (SELECT question_id, source || answer || chr(10) || '<|im_end|>' AS text FROM chat), {encode_sql('f', 'question_id', 'text', 'full_ids')},
{encode_sql('chat', 'question_id', 'source', 'source_ids')}
SELECT f.question_id, array_to_string(f.ids, ',') AS input_ids,
    array_to_string(list_transform(f.ids, lambda x, i: CASE WHEN i <= len(s.ids) THEN -100 ELSE x END), ',') AS target_ids
FROM full_ids f JOIN source_ids s USING (question_id)""")
def _(spark, sf):
    s = samples(spark, sf)
    out = TT.tokenized_dataset(s, TT.build_vocab(s.select(corpus().alias("text"))), "instruction")
    return out.select("question_id", ids_text("input_ids").alias("input_ids"), ids_text("target_ids").alias("target_ids"))


def batches_sql(source: str, size: int, multiple: int, side: str) -> str:
    pad = lambda c, fill: (
        f"list_concat({c}, list_resize([]::INTEGER[], w - len(ids), {fill}))" if side == "right"
        else f"list_concat(list_resize([]::INTEGER[], w - len(ids), {fill}), {c})"
    )
    return f"""
b0 AS (SELECT *, floor((row_number() OVER (ORDER BY question_id) - 1) / {size})::BIGINT AS batch FROM {source}),
b1 AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch) / {multiple}) * {multiple})::INTEGER AS w, count(*) OVER (PARTITION BY batch) AS n FROM b0),
batches AS (SELECT question_id, batch, n, array_to_string({pad('ids', 0)}, ',') AS input_ids,
    array_to_string({pad('list_transform(ids, lambda x: 1)', 0)}, ',') AS attention_mask, array_to_string({pad('ids', K.LABEL_MASK)}, ',') AS labels FROM b1)"""


SPLIT_SQL = r"""
ids AS (SELECT question_id, list_transform(string_split(sql_query, ' '), lambda w: len(w)::INTEGER) AS ids FROM questions)"""


def _short_ids(spark, sf):
    ids = F.transform(F.split("sql_query", " "), F.length)
    q = questions(spark, sf).select("question_id", F.slice(ids, F.lit(1), F.size(ids)).alias("input_ids"))
    return q.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))


def _texts(df):
    return df.select("question_id", "batch", *[ids_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("win_06_pad_batches_right", f"""
WITH {QUESTIONS_SQL}, {SPLIT_SQL}, {batches_sql('ids', 16, 8, 'right')} SELECT question_id, batch, input_ids, attention_mask, labels FROM batches""")
def _(spark, sf):
    return _texts(TT.pad_batches(_short_ids(spark, sf), ["question_id"], 16, 8))


@query("win_06_pad_batches_left_drop_last", f"""
WITH {QUESTIONS_SQL}, {SPLIT_SQL}, {batches_sql('ids', 10, 2, 'left')} SELECT question_id, batch, input_ids, attention_mask, labels FROM batches WHERE n = 10""")
def _(spark, sf):
    return _texts(TT.pad_batches(_short_ids(spark, sf), ["question_id"], 10, 2, "left", drop_last=True))


@query("job_07_training_batches", f"""
WITH {QUESTIONS_SQL}, {SAMPLES_SQL}, {CORPUS_SQL}, {vocab_sql('corpus', 'text')},
t AS (SELECT question_id, {TRAIN_TEXT} AS text FROM samples), {encode_sql('t', 'question_id', 'text', 'coded')},
full_ids AS (SELECT question_id, list_concat([{BOS}], ids, [{EOS}])::INTEGER[] AS ids FROM coded), {batches_sql('full_ids', 8, 8, 'right')}
SELECT question_id, batch, input_ids, attention_mask, labels FROM batches""")
def _(spark, sf):
    return _texts(training_batches(samples(spark, sf)))
