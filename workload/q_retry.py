"""Self-correction data queries: draws, corruption, contexts, the retry job."""

from pyspark.sql import functions as F

from nlsql_spark.functions.draws import pick_except, uniform
from nlsql_spark.functions.prompts import template_text
from nlsql_spark.functions.text import split_steps
from nlsql_spark.operators import retry as R
from nlsql_spark.operators.catalog import identifier_pool
from nlsql_spark.operators.linking import link_by_substring
from nlsql_spark.operators.probe import labelled_items, probe_contexts, probe_contexts_column
from workload.inputs import (
    CATALOG_SQL, KEYS_SQL, QUESTIONS_SQL, SUBSTRING_SQL, TURNS_SQL, catalog, keys, questions, stored_questions,
    table, turns, uniform_sql,
)
from workload.q_schema import LINKED_WANT, PK_SQL, ddl_sql
from workload.q_text import STEPS_SQL, lit_sql, md5
from workload.registry import query


def steps(spark, sf):
    """Model replies as step lists: the lines of assistant turns."""
    t = turns(spark, sf).filter("role = 'assistant'")
    return t.select("question_id", "conv_id", "turn", split_steps(F.col("question")).alias("reasoning_steps"))


def _joined(c="reasoning_steps"):
    return F.array_join(c, "\n")


@query("win_04_candidate_steps", f"""
WITH {TURNS_SQL}, {STEPS_SQL},
s AS (SELECT question_id, unnest(range(len(reasoning_steps))) AS i, reasoning_steps AS r FROM steps)
SELECT question_id, i::INTEGER AS i, md5(array_to_string(r[i + 2:], chr(10))) AS later,
    md5(array_to_string(list_concat(r[:i], r[i + 2:]), chr(10))) AS others FROM s""")
def _(spark, sf):
    s = steps(spark, sf)
    each = s.select("question_id", "reasoning_steps", F.explode(F.sequence(F.lit(0), F.size("reasoning_steps") - 1)).alias("i"))
    pool = lambda mode: md5(F.array_join(R.candidate_steps(F.col("reasoning_steps"), F.col("i"), mode), "\n"))
    return each.select("question_id", "i", pool(R.FROM_FUTURE).alias("later"), pool(R.FROM_PAST_AND_FUTURE).alias("others"))


def corrupt_sql(source: str, key: str, p: float, num: str, pool: str, seed: int) -> str:
    """Corrupted lists by rows: one per step, one per inserted wrong step; ``source`` has id, copy, r."""
    u = uniform_sql(f"'{seed}|' || {key} || '|' || i")
    count = f"CASE WHEN {u} < {p} THEN 1 ELSE 0 END" if num == R.SINGLE else f"floor(ln({u}) / ln({p}::DOUBLE))::INTEGER"
    size = "n - i - 1" if pool == R.FROM_FUTURE else "n - 1"
    pick = f"floor({uniform_sql(f"'{seed}|' || {key} || '|' || i || '|' || j")} * ({size}))::INTEGER"
    at = f"{pick} + i + 1" if pool == R.FROM_FUTURE else f"CASE WHEN {pick} < i THEN {pick} ELSE {pick} + 1 END"
    return f"""
c0 AS (SELECT *, len(r) AS n, unnest(range(len(r))) AS i FROM {source}),
c1 AS (SELECT *, {count} AS k FROM c0),
c2 AS (SELECT *, unnest(range(1, k + 1)) AS j FROM c1 WHERE ({size}) > 0),
c3 AS (SELECT id, copy, i, j, r[{at} + 1] || '[BACK]' AS s FROM c2 UNION ALL SELECT id, copy, i, 1000000, r[i + 1] FROM c1),
corrupted AS (SELECT id, copy, list(s ORDER BY i, j) AS r FROM c3 GROUP BY 1, 2)"""


def _corrupt(name, p, num, pool, seed):
    sql = f"""
WITH {TURNS_SQL}, {STEPS_SQL}, src AS (SELECT question_id AS id, 0 AS copy, reasoning_steps AS r FROM steps),
{corrupt_sql('src', 'id', p, num, pool, seed)}
SELECT id AS question_id, array_to_string(r, chr(10)) AS steps FROM corrupted"""

    @query(name, sql)
    def _(spark, sf):
        return R.corrupt_steps(steps(spark, sf), p, num, pool, seed).select("question_id", _joined().alias("steps"))


_corrupt("aug_01_corrupt_single_future", 0.4, R.SINGLE, R.FROM_FUTURE, 11)
_corrupt("aug_01_corrupt_single_all", 0.4, R.SINGLE, R.FROM_PAST_AND_FUTURE, 12)
_corrupt("aug_01_corrupt_multiple_future", 0.5, R.MULTIPLE, R.FROM_FUTURE, 13)
_corrupt("aug_01_corrupt_multiple_all", 0.5, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 14)


@query("aug_02_replicate", f"""
WITH {TURNS_SQL}, {STEPS_SQL}, src AS (SELECT question_id AS id, unnest(range(1, 4)) AS copy, reasoning_steps AS r FROM steps),
{corrupt_sql('src', "id || '|' || copy", 0.3, R.SINGLE, R.FROM_FUTURE, 21)}
SELECT id AS question_id, copy::INTEGER AS copy, array_to_string(r, chr(10)) AS steps FROM corrupted""")
def _(spark, sf):
    copies = R.replicate(steps(spark, sf), 3)
    return R.corrupt_steps(copies, 0.3, seed=21).select("question_id", "copy", _joined().alias("steps"))


def _prompt_case():
    t = lambda k, q: lit_sql(template_text("sql", False, k, q, False))
    yes, no = (f"CASE WHEN len(knowledge) > 0 THEN {t(True, q)} ELSE {t(False, q)} END" for q in (False, True))
    filled = lambda c: f"replace(replace({c}, '{{database_schema}}', coalesce(schema, fschema)), '{{knowledge}}', coalesce(knowledge, ''))"
    return filled(yes), filled(f"replace({no}, '{{question}}', question)")


WITH_STEPS, NO_STEPS = _prompt_case()
CONTEXT_SQL = f"""
{CATALOG_SQL}, {KEYS_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, {PK_SQL}, {LINKED_WANT}, {ddl_sql('wl', True)},
wf AS (SELECT database_name AS id, database_name, table_name, column_name, table_pos AS ord FROM catalog),
{ddl_sql('wf', False).replace('body', 'fbody').replace('ddl AS', 'fddl AS')},
ctx AS (SELECT q.*, ddl.schema, fddl.schema AS fschema FROM questions q JOIN fddl ON fddl.id = q.database_name LEFT JOIN ddl ON ddl.id = q.question_id)"""


@query("join_09_attach_context", f"""
WITH {CONTEXT_SQL}
SELECT question_id, md5(CASE WHEN flagged THEN {NO_STEPS} ELSE {WITH_STEPS} END) AS prompt, CASE WHEN NOT flagged THEN question END AS question
FROM (SELECT *, difficulty = 'simple' AS flagged FROM ctx)""")
def _(spark, sf):
    """Samples of simple questions have no steps; their prompt holds the question."""
    q, c = stored_questions(spark, sf), catalog(spark, sf)
    given = q.withColumn("reasoning_steps", F.when(F.col("difficulty") != "simple", F.col("reasoning_steps")))
    out = R.attach_context(given, link_by_substring(q, c), c, keys(spark, sf))
    return out.select("question_id", F.md5("prompt").alias("prompt"), "question")


@query("aug_03_build_retry_dataset", f"""
WITH {CONTEXT_SQL}, src AS (SELECT question_id AS id, unnest([1, 2]) AS copy, reasoning_steps AS r FROM questions WHERE database_name <> 'brand_3'),
{corrupt_sql('src', "id || '|' || copy", 0.25, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 7)}
SELECT id AS question_id, copy, md5({WITH_STEPS}) AS prompt, question, sql_query AS query, array_to_string(r, chr(10)) AS steps
FROM corrupted JOIN ctx ON ctx.question_id = id""")
def _(spark, sf):
    out = R.build_retry_dataset(
        questions(spark, sf), catalog(spark, sf), keys(spark, sf), p=0.25, copies=2, num=R.MULTIPLE,
        pool=R.FROM_PAST_AND_FUTURE, skip_databases=("brand_3",), seed=7,
    )
    return out.select("question_id", "copy", F.md5("prompt").alias("prompt"), "question", "query", _joined().alias("steps"))


@query("aug_04_perturb_identifiers", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
pool AS (SELECT database_name, list(DISTINCT table_name ORDER BY table_name) AS ts, list(DISTINCT column_name ORDER BY column_name) AS cs FROM catalog GROUP BY 1),
w AS (SELECT question_id, database_name, unnest(regexp_extract_all(sql_query, '''(?:[^'']|'''')*''|\\w+|[^\\w'']+|''')) AS s, unnest(range(len(regexp_extract_all(sql_query, '''(?:[^'']|'''')*''|\\w+|[^\\w'']+|''')))) AS i FROM questions),
k AS (SELECT w.*, {uniform_sql("'3|' || question_id || '|' || i")} < 0.3 AS hit, {uniform_sql("'3|' || question_id || '|' || i || '|pick'")} AS d,
    CASE WHEN list_contains(ts, s) THEN list_filter(ts, lambda x: x <> s) WHEN list_contains(cs, s) THEN list_filter(cs, lambda x: x <> s) END AS others
    FROM w JOIN pool USING (database_name))
SELECT question_id, string_agg(CASE WHEN hit AND others IS NOT NULL THEN coalesce(others[floor(d * len(others))::INTEGER + 1], s) ELSE s END, '' ORDER BY i) AS corrupted_query
FROM k GROUP BY 1""")
def _(spark, sf):
    out = R.perturb_identifiers(questions(spark, sf), identifier_pool(catalog(spark, sf)), 0.3, seed=3)
    return out.select("question_id", "corrupted_query")


@query("aug_05_pick_except", f"""
WITH {QUESTIONS_SQL}, p AS (SELECT question_id, list_filter(reasoning_steps, lambda x: x <> reasoning_steps[first_line]) AS o, {uniform_sql("'5|' || question_id")} AS u
    FROM questions WHERE first_line <= len(reasoning_steps))
SELECT question_id, o[floor(u * len(o))::INTEGER + 1] AS picked FROM p""")
def _(spark, sf):
    q = questions(spark, sf).filter("first_line <= size(reasoning_steps)")
    skipped = F.get("reasoning_steps", F.col("first_line") - 1)
    return q.select("question_id", pick_except(F.col("reasoning_steps"), skipped, uniform(F.lit(5), F.col("question_id"))).alias("picked"))


@query("aug_07_train_val_split", """
WITH h AS (SELECT event_id, row_number() OVER (ORDER BY md5('9|' || event_id), event_id) AS r, count(*) OVER () AS n FROM events)
SELECT event_id, r <= floor(n * 0.8) AS is_train FROM h""")
def _(spark, sf):
    return R.train_val_split(table(spark, sf, "events").select("event_id"), "event_id", 0.8, seed=9)


@query("join_12_attach_steps", rf"""
WITH {TURNS_SQL}, e AS (SELECT question_id, question FROM turns WHERE role = 'user'),
r AS (SELECT question_id - 1 AS question_id, question AS reply FROM turns WHERE role = 'assistant')
SELECT question_id, question, CASE WHEN reply IS NULL THEN '' ELSE regexp_replace(reply, '\n+', chr(10), 'g') END AS steps,
    CASE WHEN reply IS NULL THEN 0 ELSE len(string_split(regexp_replace(reply, '\n+', chr(10), 'g'), chr(10))) END::INTEGER AS n_steps
FROM e LEFT JOIN r USING (question_id)""")
def _(spark, sf):
    """User turns are entries; the next assistant turn is the reply."""
    t = turns(spark, sf)
    entries = t.filter("role = 'user'").select("question_id", "question")
    replies = t.filter("role = 'assistant'").select((F.col("question_id") - 1).alias("question_id"), F.col("question").alias("reply"))
    out = R.attach_steps(entries, replies)
    return out.select("question_id", "question", _joined().alias("steps"), F.size("reasoning_steps").alias("n_steps"))


# contexts by windows: items numbered, right texts so far, wrong texts since the last right one
def context_sql(source: str, parts: str = "1") -> str:
    return f"""
i0 AS (SELECT id, copy, i, unnest(CASE WHEN contains(s, ' [BACK] ') THEN [{{'t': split_part(s, ' [BACK] ', 1), 'y': 1, 'o': 0}}, {{'t': split_part(s, ' [BACK] ', 2), 'y': 0, 'o': 1}}]
        WHEN contains(s, '[BACK]') THEN [{{'t': replace(s, '[BACK]', ''), 'y': 1, 'o': 0}}] ELSE [{{'t': s, 'y': 0, 'o': 0}}] END) AS x
    FROM (SELECT id, copy, unnest(r) AS s, unnest(range(len(r))) AS i FROM {source})),
i1 AS (SELECT id, copy, (row_number() OVER (PARTITION BY id, copy ORDER BY i, x.o) - 1)::INTEGER AS item, regexp_replace(x.t, '^\\s+|\\s+$', '', 'g') AS t, x.y AS y FROM i0),
i2 AS (SELECT *, sum(1 - y) OVER (PARTITION BY id, copy ORDER BY item) AS run FROM i1),
i3 AS (SELECT *, string_agg(CASE WHEN y = 0 THEN t END, ' ') OVER (PARTITION BY id, copy ORDER BY item) AS rights,
    string_agg(CASE WHEN y = 1 THEN t END, ' ') OVER (PARTITION BY id, copy, run ORDER BY item) AS wrongs FROM i2),
contexts AS (SELECT id, copy, item, y::INTEGER AS label, CASE WHEN y = 0 THEN rights WHEN run = 0 THEN wrongs ELSE rights || ' ' || wrongs END AS context FROM i3)"""


@query("win_01_probe_contexts", f"""
WITH {TURNS_SQL}, {STEPS_SQL}, src AS (SELECT question_id AS id, 0 AS copy, reasoning_steps AS r FROM steps),
{corrupt_sql('src', 'id', 0.5, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 31)}, {context_sql('corrupted')}
SELECT id AS question_id, item, label, md5(context) AS context FROM contexts""")
def _(spark, sf):
    wrong = R.corrupt_steps(steps(spark, sf), 0.5, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 31)
    c = wrong.select("question_id", F.posexplode_outer(probe_contexts_column(F.col("reasoning_steps"))).alias("item", "c"))
    return c.select("question_id", "item", F.col("c.label").alias("label"), F.md5("c.context").alias("context"))


@query("win_01_probe_contexts_inline_layout", f"""
WITH {QUESTIONS_SQL}, src AS (SELECT question_id AS id, 0 AS copy,
    list_transform(reasoning_steps, lambda s, i: CASE WHEN i % 2 = 1 THEN 'Wrong ' || i || '. [BACK] ' || s ELSE s END) AS r FROM questions),
{context_sql('src')} SELECT id AS question_id, item, label, context FROM contexts""")
def _(spark, sf):
    marked = F.transform(
        "reasoning_steps",
        lambda s, i: F.when(i % 2 == 0, F.concat(F.lit("Wrong "), (i + 1).cast("string"), F.lit(". [BACK] "), s)).otherwise(s),
    )
    c = questions(spark, sf).select("question_id", F.posexplode_outer(probe_contexts_column(marked)).alias("item", "c"))
    return c.select("question_id", "item", F.col("c.label").alias("label"), F.col("c.context").alias("context"))


PROBE_SRC = f"""
{QUESTIONS_SQL}, src AS (SELECT question_id AS id, 0 AS copy, reasoning_steps AS r FROM questions),
{corrupt_sql('src', 'id', 0.3, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 41)}, {context_sql('corrupted')}"""


def probe_samples(spark, sf):
    q = R.corrupt_steps(questions(spark, sf), 0.3, R.MULTIPLE, R.FROM_PAST_AND_FUTURE, 41)
    return q.select("question_id", F.concat("database_name", F.lit(" schema\n")).alias("prompt"), "question", "reasoning_steps")


@query("job_08_probe_dataset", f"""
WITH {PROBE_SRC}
SELECT question_id, item, label, md5('[CONTEXT] ' || database_name || ' schema' || chr(10) || '[QUESTION] ' || question || chr(10) || '[REASONING] ' || context) AS text
FROM contexts JOIN questions ON question_id = id""")
def _(spark, sf):
    return probe_contexts(probe_samples(spark, sf)).withColumn("text", F.md5("text"))


@query("agg_13_label_counts", f"WITH {PROBE_SRC} SELECT sum(label)::BIGINT AS wrong, sum(1 - label)::BIGINT AS correct FROM contexts")
def _(spark, sf):
    items = probe_samples(spark, sf).select(F.inline(labelled_items(F.col("reasoning_steps"))))
    from nlsql_spark.operators.probe import label_counts

    return label_counts(items)
