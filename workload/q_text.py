"""Text, prompt and array columns over the given tables."""

from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions import text as X
from nlsql_spark.functions import training as T
from nlsql_spark.functions.prompts import fill_prompt, prompt_template, reasoning_request, template_inputs, template_text
from nlsql_spark.functions.rewards import ves_reward
from nlsql_spark.functions.vectors import l2_normalize
from nlsql_spark.operators.linking import mentioned_columns, pairs_to_links
from workload.inputs import (
    CATALOG_SQL, QUESTIONS_SQL, TURNS_SQL, link_text_sql, links_text, questions, table, tokens_sql, turns,
)
from workload.registry import query

md5 = lambda c: F.md5(F.encode(c, "utf-8"))


def lit_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("prj_01_normalize_identifier", """
SELECT p_partkey, lower(replace(replace(p_brand || ' ' || p_name, '"', ''), '`', '')) AS name FROM part""")
def _(spark, sf):
    messy = F.concat(F.lit(' \t"'), "p_brand", F.lit(" "), "p_name", F.lit('`"\n'))
    return table(spark, sf, "part").select("p_partkey", X.normalize_identifier(messy).alias("name"))


@query("prj_02_normalize_link_text", f"SELECT doc_id, md5({link_text_sql('text')}) AS link_text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5(X.normalize_link_text(F.col("text"))).alias("link_text"))


@query("prj_03_link_tokens", f"""
SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens
FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.link_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), md5(F.array_join("t", " ")).alias("tokens"))


@query("prj_04_normalize_text", r"""
SELECT doc_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS normal FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5(X.normalize_text(F.col("text"))).alias("normal"))


@query("prj_05_normalize_record", """
SELECT c_custkey, lower(trim(c_name)) AS c_name, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return X.normalize_record(c, ["c_name", "c_mktsegment"])


@query("prj_06_question_text", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, lower(question) || ' ' || lower(coalesce(knowledge, '')) AS full_text, lower(question) AS short_text FROM questions""")
def _(spark, sf):
    q = questions(spark, sf)
    return q.select(
        "question_id", X.question_text(F.col("question"), F.col("knowledge")).alias("full_text"),
        X.question_text(F.col("question")).alias("short_text"),
    )


# a line item as one column record with a short value list
LINES_SQL = """
rec AS (SELECT l_orderkey, l_linenumber, l_partkey,
    [l_quantity::INTEGER::VARCHAR, l_linenumber::VARCHAR, NULL, l_linenumber::VARCHAR, (l_suppkey % 9)::VARCHAR] AS nums,
    [l_linestatus, l_returnflag, NULL, l_returnflag || l_linestatus, l_linestatus, CASE WHEN l_linenumber > 3 THEN l_returnflag END, 'Z'] AS flags
    FROM lineitem)"""


def _lines(spark, sf):
    c = F.col
    text = lambda x: x.cast("string")
    null = F.lit(None).cast("string")
    nums = F.array(
        text(c("l_quantity").cast("int")), text(c("l_linenumber")), null, text(c("l_linenumber")), text(c("l_suppkey") % 9)
    )
    flags = F.array(
        c("l_linestatus"), c("l_returnflag"), null, F.concat("l_returnflag", "l_linestatus"), c("l_linestatus"),
        F.when(c("l_linenumber") > 3, c("l_returnflag")), F.lit("Z"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nums.alias("nums"), flags.alias("flags"))


@query("prj_07_document_text", f"""
WITH {CATALOG_SQL}
SELECT database_name, table_name, column_name,
    CASE WHEN NOT ((is_primary_key OR is_foreign_key) AND data_format <> 'text') THEN
        table_name || ' ' || column_name || ' column of ' || database_name || ' ' || data_format || ' ' || coalesce(default_value, '') END AS document
FROM catalog""")
def _(spark, sf):
    from workload.inputs import catalog

    c = catalog(spark, sf)
    out = X.excluded_column(
        F.col("is_primary_key") | F.col("is_foreign_key"), F.col("data_format"), F.col("column_name"),
        F.col("default_value"), numeric_keys=True,
    )
    text = X.document_text(
        F.col("table_name"), F.col("column_name"), F.concat(F.lit("Column of "), "database_name"), F.col("data_format"),
        F.coalesce("default_value", F.lit("")), out,
    )
    return c.select("database_name", "table_name", "column_name", text.alias("document"))


@query("prj_08_serialize_values", f"""
WITH {LINES_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, lower(array_to_string(list_transform(flags, lambda f: coalesce(f, 'None')), ' ')) AS serial FROM rec""")
def _(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", X.serialize_values(F.col("flags")).alias("serial"))


@query("prj_09_representative_values", f"""
WITH {LINES_SQL},
u AS (SELECT l_orderkey, l_linenumber, l_partkey, list_transform(list_filter(nums, lambda v: v IS NOT NULL), lambda v: v::INTEGER) AS n,
    list_filter(flags, lambda v: v IS NOT NULL) AS f FROM rec),
r AS (SELECT *, list_sort(list_transform(list_distinct(f), lambda v: {{'a': -len(list_filter(f, lambda y: y = v)), 'b': list_position(f, v), 'c': v}})) AS s FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, list_min(n) || ' ' || list_max(n) AS span,
    lower(array_to_string(list_transform(s[1:3], lambda x: x['c']), ' ')) AS top FROM r""")
def _(spark, sf):
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.representative_values(F.col("nums"), F.lit("integer")).alias("span"),
        X.representative_values(F.col("flags"), F.lit("text")).alias("top"),
    )


def _template_sql(kind, **kw):
    yes = lit_sql(template_text(kind, kw["use_cot"], True, kw["with_question"], kw["open_select"]))
    no = lit_sql(template_text(kind, kw["use_cot"], False, kw["with_question"], kw["open_select"]))
    return f"CASE WHEN len(knowledge) > 0 THEN {yes} ELSE {no} END"


SQL_TEMPLATE = _template_sql("sql", use_cot=True, with_question=True, open_select=True)
LINK_TEMPLATE = _template_sql("schema_linking", use_cot=False, with_question=True, open_select=False)


@query("prj_12_prompt_template", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, md5({SQL_TEMPLATE}) AS sql_template, md5({LINK_TEMPLATE}) AS link_template FROM questions""")
def _(spark, sf):
    k = F.col("knowledge")
    return questions(spark, sf).select(
        "question_id", md5(prompt_template("sql", k, use_cot=True)).alias("sql_template"),
        md5(prompt_template("schema_linking", k)).alias("link_template"),
    )


@query("prj_13_fill_prompt", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, replace(replace(replace({LINK_TEMPLATE}, '{{question}}', question), '{{database_schema}}', sql_query),
    '{{knowledge}}', coalesce(knowledge, '')) AS prompt FROM questions""")
def _(spark, sf):
    k = F.col("knowledge")
    template = prompt_template("schema_linking", k)
    return questions(spark, sf).select(
        "question_id", fill_prompt(template, F.col("sql_query"), k, F.col("question")).alias("prompt")
    )


@query("prj_14_template_inputs", f"""
WITH {QUESTIONS_SQL}, e AS (
SELECT question_id, 'question' AS field, question AS value FROM questions
UNION ALL SELECT question_id, 'knowledge', knowledge FROM questions WHERE len(knowledge) > 0)
SELECT question_id, field, value FROM e""")
def _(spark, sf):
    q = questions(spark, sf).withColumn("template", prompt_template("schema_linking", F.col("knowledge")))
    filled = template_inputs(q, F.col("template"), ["question", "knowledge", "difficulty"])
    return filled.select("question_id", F.explode("input_mappings").alias("field", "value"))


@query("prj_15_clean_sql", r"""
SELECT doc_id, md5(regexp_replace(split_part(replace(replace(replace(replace(translate(t, chr(9) || chr(10), '  '), '\"', '"'), '``', '`'), '<eos>', ''), '<|im_end|>', ''), '[SQL]', -1), '^\s+|\s+$', '', 'g')) AS cleaned
FROM (SELECT doc_id, 'SELECT ' || source || chr(9) || '[SQL] ``' || lang || '`` \"' || text || '\"<|im_end|><eos> ' AS t FROM documents)""")
def _(spark, sf):
    messy = F.concat(
        "source", F.lit("\t[SQL] ``"), "lang", F.lit('`` \\"'), "text", F.lit('\\"<|im_end|><eos> ')
    )
    cleaned = X.clean_sql(messy, add_select=True, with_reasoning=True)
    return table(spark, sf, "documents").select("doc_id", md5(cleaned).alias("cleaned"))


@query("prj_15_clean_sql_after_question", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, trim(sql_query) AS cleaned FROM questions""")
def _(spark, sf):
    reply = F.concat(F.lit("-- "), "question", F.lit("\n "), "sql_query", F.lit(" "))
    return questions(spark, sf).select("question_id", X.clean_sql(reply, F.col("question")).alias("cleaned"))


@query("prj_16_rescue_sql", r"""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN md5(regexp_replace(replace(replace(text, '"', ''), chr(10), ' '), '^\s+|\s+$', '', 'g'))
    ELSE md5(lang) END AS sql_query FROM documents""")
def _(spark, sf):
    body = F.replace(F.col("text"), F.lit('"'), F.lit(""))
    error = (
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit('Invalid json: { "sql":\n "'), body, F.lit('" } at 0')))
        .when(F.col("n_chars") % 3 == 1, F.lit("None"))
    )
    return table(spark, sf, "documents").select("doc_id", md5(X.rescue_sql(F.col("lang"), error)).alias("sql_query"))


STEPS_SQL = r"""
steps AS (SELECT question_id, conv_id, turn, string_split(regexp_replace(question, '\n+', chr(10), 'g'), chr(10)) AS reasoning_steps
    FROM turns WHERE role = 'assistant')"""


@query("prj_17_split_steps", f"""
WITH {TURNS_SQL}, {STEPS_SQL}
SELECT question_id, (unnest(range(len(reasoning_steps))))::INTEGER AS pos, unnest(reasoning_steps) AS step FROM steps""")
def _(spark, sf):
    t = turns(spark, sf).filter("role = 'assistant'")
    return t.select("question_id", F.posexplode(X.split_steps(F.col("question"))).alias("pos", "step"))


def _train_sql(mode):
    if mode == "train":
        return """'[CONTEXT] ' || p || '[QUESTION] ' || question || chr(10) || '[REASONING] ' || array_to_string(reasoning_steps, ' ') || ' [SQL] ' || sql_query"""
    return """'[CONTEXT] ' || p || '[QUESTION] ' || question || chr(10) || '[REASONING] '"""


# half of the questions (those with knowledge) carry steps, the others are plain prompt / query samples
SAMPLES_SQL = """
samples AS (SELECT question_id, database_name || ' schema' || chr(10) AS p, sql_query, reasoning_steps,
    CASE WHEN knowledge IS NOT NULL THEN question END AS question FROM questions)"""


def samples(spark, sf):
    q = questions(spark, sf)
    return q.select(
        "question_id", F.concat("database_name", F.lit(" schema\n")).alias("prompt"), F.col("sql_query").alias("query"),
        "reasoning_steps", F.when(F.col("knowledge").isNotNull(), F.col("question")).alias("question"),
    )


@query("prj_18_training_text", f"""
WITH {QUESTIONS_SQL}, {SAMPLES_SQL}
SELECT question_id, CASE WHEN question IS NOT NULL THEN {_train_sql('train')} ELSE p || ' ' || sql_query END AS text FROM samples""")
def _(spark, sf):
    c = F.col
    return samples(spark, sf).select(
        "question_id", T.training_text(c("prompt"), c("question"), c("reasoning_steps"), c("query")).alias("text")
    )


@query("prj_19_evaluation_text", f"""
WITH {QUESTIONS_SQL}, {SAMPLES_SQL}
SELECT question_id, CASE WHEN question IS NOT NULL THEN {_train_sql('eval')} ELSE p || chr(10) || 'SELECT ' END AS text FROM samples""")
def _(spark, sf):
    return samples(spark, sf).select("question_id", T.evaluation_text(F.col("prompt"), F.col("question")).alias("text"))


PAIR_SQL = """
pairs AS (SELECT question_id, CASE WHEN question IS NOT NULL THEN '[CONTEXT] ' || p || '[QUESTION] ' || question ELSE p END AS instruction,
    CASE WHEN question IS NOT NULL THEN '[REASONING] ' || array_to_string(reasoning_steps, ' ') || ' [SQL] ' || sql_query ELSE sql_query END AS answer,
    CASE WHEN question IS NOT NULL THEN '[REASONING] ' ELSE 'SELECT ' END AS opening FROM samples)"""


@query("prj_20_instruction_pair", f"WITH {QUESTIONS_SQL}, {SAMPLES_SQL}, {PAIR_SQL} SELECT question_id, instruction, answer, opening FROM pairs")
def _(spark, sf):
    c = F.col
    instruction, answer = T.instruction_pair(c("prompt"), c("question"), c("reasoning_steps"), c("query"))
    _, opening = T.instruction_pair(c("prompt"), c("question"), mode="eval")
    return samples(spark, sf).select("question_id", instruction.alias("instruction"), answer.alias("answer"), opening.alias("opening"))


@query("prj_21_render_chat", f"""
WITH {QUESTIONS_SQL}, m AS (SELECT question_id, unnest([1, 2, 3]) AS turn, unnest(['system', 'user', 'assistant']) AS role,
    unnest(['database ' || database_name, question, sql_query]) AS content FROM questions)
SELECT question_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS chat
FROM m GROUP BY question_id""")
def _(spark, sf):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    talk = F.array(
        message("system", F.concat(F.lit("database "), "database_name")), message("user", F.col("question")),
        message("assistant", F.col("sql_query")),
    )
    return questions(spark, sf).select("question_id", T.render_chat(talk, add_generation_prompt=True).alias("chat"))


@query("prj_22_mask_keys", """
SELECT event_id, '***' AS user_id, event_type FROM events""")
def _(spark, sf):
    m = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"))
    masked = table(spark, sf, "events").select("event_id", X.mask_keys(m, ["user_id", "password"]).alias("m"))
    return masked.select("event_id", F.col("m.user_id").alias("user_id"), F.col("m.event_type").alias("event_type"))


@query("prj_23_map_difficulty", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, CASE difficulty WHEN 'simple' THEN 'EASY' WHEN 'moderate' THEN 'MEDIUM' ELSE 'HARD' END AS level FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", X.map_difficulty(F.col("difficulty")).alias("level"))


@query("prj_24_prefix_query", f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN '{K.QUERY_PREFIX}' || text ELSE text END AS input FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.prefix_query(F.col("text"), F.col("role") == "user").alias("input")
    )


@query("prj_25_l2_normalize", """
WITH n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS norm FROM embeddings)
SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS dim, round(unnest(embedding)::DOUBLE / norm, 6) AS x FROM n""")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return v.withColumn("x", F.round("x", 6))


@query("prj_26_ves_reward", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice / (l_quantity * 1000) AS ratio, l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE WHEN ratio >= 2 THEN 1.25::DOUBLE
    WHEN ratio >= 1 THEN 1.0::DOUBLE WHEN ratio >= 0.5 THEN 0.75::DOUBLE WHEN ratio >= 0.25 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS reward FROM r""")
def _(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / (F.col("l_quantity") * 1000))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", ves_reward(ratio).alias("reward")
    )


# word lengths of a text stand in for ids
IDS_SQL = r"ids AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: len(w)::INTEGER) AS ids FROM documents)"


def _ids(spark, sf):
    d = table(spark, sf, "documents")
    pieces = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return d.select("doc_id", F.transform(pieces, F.length).alias("ids"))


@query("prj_27_add_special_ids", f"""
WITH {IDS_SQL}
SELECT doc_id, md5(array_to_string(list_concat([2], ids, [3]), ',')) AS train_ids, md5(array_to_string(list_concat([2], ids), ',')) AS eval_ids,
    (len(ids) + 2)::INTEGER AS attended FROM ids""")
def _(spark, sf):
    joined = lambda c: md5(F.array_join(c.cast("array<string>"), ","))
    train = T.add_special_ids(F.col("ids"), 2, 3)
    return _ids(spark, sf).select(
        "doc_id", joined(train).alias("train_ids"), joined(T.add_special_ids(F.col("ids"), 2)).alias("eval_ids"),
        F.aggregate(T.full_attention(train), F.lit(0), lambda a, x: a + x).alias("attended"),
    )


@query("prj_28_mask_labels", f"""
WITH {IDS_SQL}, n AS (SELECT *, len(ids) // 2 AS cut FROM ids)
SELECT doc_id, md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= cut THEN -100 ELSE x END), ',')) AS source_masked,
    md5(array_to_string(list_transform(ids, lambda x: CASE WHEN x > 5 THEN -100 ELSE x END), ',')) AS pad_masked FROM n""")
def _(spark, sf):
    joined = lambda c: md5(F.array_join(c.cast("array<string>"), ","))
    half = F.floor(F.size("ids") / 2).cast("int")
    attention = F.transform("ids", lambda x: F.when(x > 5, 0).otherwise(1))
    return _ids(spark, sf).select(
        "doc_id", joined(T.mask_source_labels(F.col("ids"), half)).alias("source_masked"),
        joined(T.mask_padded_labels(F.col("ids"), attention)).alias("pad_masked"),
    )


@query("prj_29_trim_input_ids", f"""
WITH {IDS_SQL}, n AS (SELECT *, len(list_filter(ids, lambda x: x < 4)) AS k FROM ids)
SELECT doc_id, (len(ids) - k)::INTEGER AS n, md5(array_to_string(ids[k + 1:], ',')) AS trimmed FROM n""")
def _(spark, sf):
    attention = F.transform("ids", lambda x: F.when(x < 4, 1).otherwise(0))
    d = _ids(spark, sf).select("doc_id", T.trim_input_ids(F.col("ids"), attention).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), md5(F.array_join(F.col("t").cast("array<string>"), ",")).alias("trimmed"))


@query("prj_30_pairs_to_links", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    unnest([l_returnflag, l_linestatus, l_returnflag, l_returnflag]) AS t,
    unnest([l_linenumber::VARCHAR, l_linenumber::VARCHAR, l_linenumber::VARCHAR, (l_suppkey % 7)::VARCHAR]) AS c, rid
    FROM (SELECT *, row_number() OVER () AS rid FROM lineitem)),
d AS (SELECT DISTINCT * FROM p),
g AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, t, string_agg(c, '|' ORDER BY c) AS cols FROM d GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, string_agg(t || '(' || cols || ')', ';' ORDER BY t) AS links
FROM g GROUP BY rid, l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def _(spark, sf):
    pair = lambda t, c: F.struct(F.col(t).alias("table_name"), c.cast("string").alias("column_name"))
    line = F.col("l_linenumber")
    chosen = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array(
            pair("l_returnflag", line), pair("l_linestatus", line), pair("l_returnflag", line),
            pair("l_returnflag", F.col("l_suppkey") % 7),
        ).alias("pairs"),
    )
    return pairs_to_links(chosen).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", links_text().alias("links"))


@query("prj_31_last_attended", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, reasoning_steps[least(len(reasoning_steps), first_line)] AS last_step FROM questions""")
def _(spark, sf):
    attention = F.transform("reasoning_steps", lambda s, i: F.when(i < F.col("first_line"), 1).otherwise(0))
    return questions(spark, sf).select("question_id", T.last_attended(F.col("reasoning_steps"), attention).alias("last_step"))


@query("prj_32_reasoning_request", f"""
WITH {QUESTIONS_SQL}
SELECT question_id, md5(replace({lit_sql(K.STEP_REQUEST)}, '{{sql_query}}', sql_query)) AS request FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", md5(reasoning_request(F.col("sql_query"))).alias("request"))


@query("flt_03_drop_null_items", f"""
WITH {LINES_SQL}
SELECT l_orderkey, array_to_string(list_filter(flags, lambda f: f IS NOT NULL), ',') AS present FROM rec""")
def _(spark, sf):
    return _lines(spark, sf).select("l_orderkey", F.array_join(X.drop_null_items(F.col("flags")), ",").alias("present"))


@query("flt_05_mentioned", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}
SELECT q.question_id, c.table_name, c.column_name FROM questions q JOIN catalog c ON q.database_name = c.database_name
WHERE contains(lower(q.sql_query), c.table_name) AND contains(lower(q.sql_query), c.column_name)""")
def _(spark, sf):
    from workload.inputs import catalog

    return mentioned_columns(questions(spark, sf), catalog(spark, sf))


@query("flt_06_tokens_match", """
SELECT o_orderkey, levenshtein(o_orderpriority, o_orderstatus || '-LOW') <= 3 AS near,
    o_orderpriority = o_orderstatus || '-LOW' AS same FROM orders""")
def _(spark, sf):
    other = F.concat("o_orderstatus", F.lit("-LOW"))
    return table(spark, sf, "orders").select(
        "o_orderkey", X.tokens_match(F.col("o_orderpriority"), other, 3).alias("near"),
        X.tokens_match(F.col("o_orderpriority"), other).alias("same"),
    )


@query("flt_07_any_token_match", f"""
WITH {QUESTIONS_SQL}, t AS (SELECT question_id, {tokens_sql('question')} AS qt, {tokens_sql('knowledge')} AS kt FROM questions WHERE knowledge IS NOT NULL),
n AS (SELECT question_id, bool_or(levenshtein(a, b) <= 1) AS near FROM (SELECT question_id, unnest(qt) AS a, kt FROM t), unnest(kt) AS u(b) GROUP BY 1)
SELECT t.question_id, list_has_any(qt, kt) AS same, coalesce(near, false) AS near FROM t LEFT JOIN n USING (question_id)""")
def _(spark, sf):
    q = questions(spark, sf).filter("knowledge is not null")
    t = q.select("question_id", X.link_tokens(F.col("question")).alias("qt"), X.link_tokens(F.col("knowledge")).alias("kt"))
    return t.select(
        "question_id", X.any_token_match(F.col("qt"), F.col("kt")).alias("same"),
        X.any_token_match(F.col("qt"), F.col("kt"), 1).alias("near"),
    )


@query("flt_08_known_format", f"""
WITH {CATALOG_SQL}
SELECT database_name, table_name, column_name, data_format IN ('integer', 'real', 'date', 'datetime', 'text') AS known,
    coalesce(default_value IN ('integer', 'real', 'date', 'datetime', 'text'), false) AS default_known FROM catalog""")
def _(spark, sf):
    from workload.inputs import catalog

    return catalog(spark, sf).select(
        "database_name", "table_name", "column_name", X.is_known_format(F.col("data_format")).alias("known"),
        F.coalesce(X.is_known_format(F.col("default_value")), F.lit(False)).alias("default_known"),
    )
