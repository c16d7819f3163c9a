"""Schema text and link repair queries."""

from pyspark.sql import functions as F

from nlsql_spark.functions.prompts import template_text
from nlsql_spark.operators import schema_text as S
from nlsql_spark.operators.linking import link_by_substring
from nlsql_spark.plans.jobs import schema_prompts
from workload.inputs import (
    CATALOG_SQL, KEYS_SQL, QUESTIONS_SQL, SUBSTRING_SQL, catalog, keys, links_text, stored_questions,
    table,
)
from workload.q_text import lit_sql
from workload.registry import query

# CREATE TABLE text per (link id, table) from rows want(id, database_name, table_name, column_name)
LINE_SQL = """'`' || c.column_name || '` ' || upper(c.data_format) || coalesce('  default ' || c.default_value, '')
    || CASE WHEN c.is_not_null THEN '  not null' ELSE '  null' END
    || CASE WHEN c.is_primary_key AND p.n_pk = 1 THEN '  PRIMARY KEY' ELSE '' END"""

PK_SQL = """
pk AS (SELECT database_name, table_name, count(*) AS n_pk, list(local_column ORDER BY seq) AS pk_cols,
    string_agg('`' || local_column || '`', ', ' ORDER BY seq) AS pk_text FROM keys WHERE kind = 'pk' GROUP BY 1, 2),
fk AS (SELECT database_name, table_name, local_column, ref_table, ref_column FROM keys WHERE kind = 'fk')"""


def ddl_sql(want: str, filtered: bool) -> str:
    """One row per (id, table): table_pos and the statement."""
    constraints = f"""
    || coalesce((SELECT string_agg(',' || chr(10) || 'FOREIGN KEY (`' || f.local_column || '`) REFERENCES `' || f.ref_table || '` (`' || f.ref_column || '`)', '')
        FROM fk f WHERE f.database_name = b.database_name AND f.table_name = b.table_name AND list_contains(b.cols, f.local_column)), '')
    || coalesce((SELECT ',' || chr(10) || 'PRIMARY KEY (' || p.pk_text || ')' FROM pk p WHERE p.database_name = b.database_name
        AND p.table_name = b.table_name AND p.n_pk > 1 AND list_has_all(b.cols, p.pk_cols)), '')""" if filtered else ""
    return f"""
body AS (SELECT w.id, c.database_name, c.table_name, any_value(w.ord) AS ord, list(c.column_name) AS cols,
        string_agg({LINE_SQL}, ',' || chr(10) ORDER BY c.column_pos) AS lines
    FROM {want} w JOIN catalog c ON c.database_name = w.database_name AND c.table_name = w.table_name AND c.column_name = w.column_name
    JOIN pk p ON p.database_name = c.database_name AND p.table_name = c.table_name GROUP BY 1, 2, 3),
ddl AS (SELECT id, string_agg('CREATE TABLE `' || table_name || '`' || chr(10) || '(' || chr(10) || lines {constraints} || chr(10) || ');', chr(10) || chr(10) ORDER BY ord) AS schema
    FROM body b GROUP BY id)"""


FULL_SQL = "wf AS (SELECT database_name AS id, database_name, table_name, column_name, table_pos AS ord FROM catalog)"


@query("prj_10_render_ddl", f"WITH {CATALOG_SQL}, {KEYS_SQL}, {PK_SQL}, {FULL_SQL}, {ddl_sql('wf', False)} SELECT id AS database_name, schema AS database_schema FROM ddl")
def _(spark, sf):
    return S.render_ddl(catalog(spark, sf), keys(spark, sf))


LINKED_WANT = """wl AS (SELECT sl.question_id AS id, q.database_name, sl.table_name, unnest(sl.columns) AS column_name, sl.table_pos AS ord
    FROM sl JOIN questions q USING (question_id))"""


@query("prj_10_render_linked_ddl", f"""
WITH {CATALOG_SQL}, {KEYS_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, {PK_SQL}, {LINKED_WANT}, {ddl_sql('wl', True)}
SELECT question_id, coalesce(schema, 'none') AS database_schema FROM questions LEFT JOIN ddl ON ddl.id = question_id""")
def _(spark, sf):
    q, c = stored_questions(spark, sf), catalog(spark, sf)
    asked = q.select("question_id", "database_name", F.lit("none").alias("database_schema"))
    out = S.apply_links(asked, link_by_substring(q, c), c, keys(spark, sf), repair=False)
    return out.select("question_id", "database_schema")


@query("aug_06_shuffle_columns", f"""
WITH {CATALOG_SQL}, {KEYS_SQL}, {PK_SQL}, t AS (
SELECT c.database_name, c.table_name, min(c.table_pos) AS ord, string_agg({LINE_SQL}, ',' || chr(10) ORDER BY md5('5|' || c.table_name || '|' || c.column_name), c.column_name) AS lines
    FROM catalog c JOIN pk p ON p.database_name = c.database_name AND p.table_name = c.table_name GROUP BY 1, 2)
SELECT database_name, string_agg('CREATE TABLE `' || table_name || '`' || chr(10) || '(' || chr(10) || lines || chr(10) || ');', chr(10) || chr(10) ORDER BY ord) AS database_schema
FROM t GROUP BY 1""")
def _(spark, sf):
    return S.render_ddl(catalog(spark, sf), keys(spark, sf), shuffle_seed=5)


@query("src_09_sample_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return S.sample_rows(o, 5, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("prj_11_render_sample_rows", """
WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey::VARCHAR AS a, c_name AS b,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c FROM customer),
t AS (SELECT c_nationkey, n, a, b, coalesce(c, 'None') AS c FROM r WHERE n <= 3
    UNION ALL SELECT DISTINCT c_nationkey, 0, 'c_custkey', 'c_name', 'c_mktsegment' FROM customer),
w AS (SELECT *, max(len(a)) OVER g AS wa, max(len(b)) OVER g AS wb, max(len(c)) OVER g AS wc FROM t WINDOW g AS (PARTITION BY c_nationkey))
SELECT c_nationkey, string_agg(lpad(a, wa::INTEGER, ' ') || ' ' || lpad(b, wb::INTEGER, ' ') || ' ' || lpad(c, wc::INTEGER, ' ') || ' ', chr(10) ORDER BY n) AS rows_text FROM w GROUP BY 1""")
def _(spark, sf):
    first = S.sample_rows_per_group(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], 3)
    cells = F.array(
        F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    )
    # at most three rows per group
    rows = first.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("row_no", cells.alias("v")))).alias("r"))
    names = F.array(F.lit("c_custkey"), F.lit("c_name"), F.lit("c_mktsegment"))
    return rows.select("c_nationkey", S.sample_rows_text(names, F.col("r.v")).alias("rows_text"))


# links with messy names: the substring links, quoted and in capitals, plus an unknown table and column
MENDED_SQL = """
hit AS (SELECT sl.question_id, q.database_name, sl.table_name, unnest(sl.columns) AS column_name, sl.table_pos FROM sl JOIN questions q USING (question_id)),
hits AS (SELECT hit.*, c.column_pos FROM hit JOIN catalog c USING (database_name, table_name, column_name)),
missing AS (SELECT DISTINCT h.question_id, h.database_name, h.table_name, c.column_name, h.table_pos, c.column_pos FROM hits h JOIN catalog c
    ON c.database_name = h.database_name AND c.table_name = h.table_name AND (c.is_primary_key OR c.is_foreign_key)
    WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.question_id = h.question_id AND x.table_name = h.table_name AND x.column_name = c.column_name)),
mended AS (SELECT question_id, database_name, table_name, column_name, table_pos, 0 AS part, 0 AS place FROM hits
    UNION ALL SELECT question_id, database_name, table_name, column_name, table_pos, 1, column_pos FROM missing)"""


def _messy(spark, sf, q):
    c = catalog(spark, sf)
    links = link_by_substring(q, c).join(q.select("question_id", "database_name"), "question_id")
    messy = F.transform(
        "schema_links",
        lambda x: F.struct(
            F.concat(F.lit(' "'), F.upper(x["table_name"]), F.lit('"')).alias("table_name"),
            F.concat(F.transform(x["columns"], lambda n: F.concat(F.lit("`"), F.initcap(n), F.lit("` "))), F.array(F.lit("no_such"))).alias("columns"),
        ),
    )
    ghost = F.expr("array(named_struct('table_name', 'ghost', 'columns', array('x')))")
    return links.withColumn("schema_links", F.concat(messy, ghost)), c


@query("join_07_repair_links", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, {MENDED_SQL},
g AS (SELECT question_id, table_name, any_value(table_pos) AS ord, string_agg(column_name, '|' ORDER BY part, place, column_name) AS cols FROM mended GROUP BY 1, 2)
SELECT question_id, coalesce(string_agg(table_name || '(' || cols || ')', ';' ORDER BY ord), '') AS links FROM questions LEFT JOIN g USING (question_id) GROUP BY 1""")
def _(spark, sf):
    links, c = _messy(spark, sf, stored_questions(spark, sf))
    return S.repair_links(links, c).select("question_id", links_text().alias("links"))


SQL_TEMPLATE = f"""CASE WHEN len(knowledge) > 0 THEN {lit_sql(template_text('sql', False, True, True, True))}
    ELSE {lit_sql(template_text('sql', False, False, True, True))} END"""
MENDED_WANT = "wm AS (SELECT question_id AS id, database_name, table_name, column_name, table_pos AS ord FROM mended)"


def _prompt_sql(head: str) -> str:
    return f"""
WITH {CATALOG_SQL}, {KEYS_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, {PK_SQL}, {MENDED_SQL}, {MENDED_WANT}, {ddl_sql('wm', True)},
{FULL_SQL}, {ddl_sql('wf', False).replace('body', 'fbody').replace('ddl AS', 'fddl AS')}
{head} FROM questions q JOIN fddl ON fddl.id = q.database_name LEFT JOIN ddl ON ddl.id = q.question_id"""


@query("join_10_apply_links", _prompt_sql("SELECT q.question_id, md5(coalesce(ddl.schema, fddl.schema)) AS database_schema"))
def _(spark, sf):
    asked = stored_questions(spark, sf)
    links, c = _messy(spark, sf, asked)
    k = keys(spark, sf)
    q = asked.select("question_id", "database_name")
    return S.apply_links(q, links, c, k, full_schema=S.render_ddl(c, k)).select("question_id", F.md5("database_schema").alias("database_schema"))


@query("job_05_schema_prompts", _prompt_sql(f"""
SELECT q.question_id, md5(replace(replace(replace({SQL_TEMPLATE}, '{{question}}', question), '{{database_schema}}', coalesce(ddl.schema, fddl.schema)),
    '{{knowledge}}', coalesce(knowledge, ''))) AS prompt"""))
def _(spark, sf):
    asked = stored_questions(spark, sf)
    links, c = _messy(spark, sf, asked)
    out = schema_prompts(asked, links, c, keys(spark, sf))
    return out.select("question_id", F.md5("prompt").alias("prompt"))
