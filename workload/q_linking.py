"""Linking queries: catalogue joins, substring, token and edit-distance links, link scores."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlsql_spark.functions.text import link_tokens
from nlsql_spark.operators import catalog as C
from nlsql_spark.operators import link_metrics as M
from nlsql_spark.operators import linking as L
from nlsql_spark.operators.retry import exclude_databases
from nlsql_spark.plans.jobs import link_report
from nlsql_spark.session import materialize
from workload.inputs import (
    CATALOG_SQL, KEYS_SQL, QUESTIONS_SQL, SUBSTRING_SQL, TURNS_SQL, WORD_CATALOG_SQL, catalog, keys, links_text, questions, stored_questions, table, tokens_sql, turns, word_catalog,
)
from workload.registry import query

LINKS_FROM_SL = """
SELECT q.question_id, coalesce(string_agg(sl.table_name || '(' || array_to_string(sl.columns, '|') || ')', ';' ORDER BY sl.table_pos), '') AS links
FROM questions q LEFT JOIN sl USING (question_id) GROUP BY q.question_id"""


@query("flt_01_exclude_databases", f"""
WITH {QUESTIONS_SQL} SELECT question_id, database_name FROM questions WHERE database_name NOT IN ('brand_1', 'brand_7')""")
def _(spark, sf):
    return exclude_databases(questions(spark, sf), ["brand_1", "brand_7"]).select("question_id", "database_name")


@query("flt_02_exclude_columns", f"""
WITH {CATALOG_SQL}, c AS (SELECT *, is_primary_key OR is_foreign_key AS k FROM catalog)
SELECT database_name, table_name, column_name, k AS all_keys, k AND data_format <> 'text' AS numeric_keys,
    k AND column_pos % 2 = 0 AS uuid_keys, contains(column_name, 'id') AS id_in_name FROM c""")
def _(spark, sf):
    from nlsql_spark.functions.text import excluded_column

    key, fmt, name = F.col("is_primary_key") | F.col("is_foreign_key"), F.col("data_format"), F.col("column_name")
    first = F.when(F.col("column_pos") % 2 == 0, F.lit("x 9b2c1f00-1234-4abc-8def-0123456789ab")).otherwise(
        F.lit("9B2C1F00-1234-4ABC-8DEF-0123456789AB")
    )
    rule = lambda which: excluded_column(key, fmt, name, first, **{which: True}).alias(which)
    return catalog(spark, sf).select(
        "database_name", "table_name", "column_name", *[rule(r) for r in ("all_keys", "numeric_keys", "uuid_keys", "id_in_name")]
    )


@query("join_01_join_catalog", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
n AS (SELECT database_name, count(DISTINCT table_name) AS n_tables, count(*) AS n_columns FROM catalog GROUP BY 1)
SELECT question_id, n_tables::INTEGER AS n_tables, n_columns::INTEGER AS n_columns FROM questions JOIN n USING (database_name)""")
def _(spark, sf):
    joined = L.join_catalog(questions(spark, sf), catalog(spark, sf))
    columns = F.aggregate("tables", F.lit(0), lambda a, t: a + F.size(t["columns"]))
    return joined.select("question_id", F.size("tables").alias("n_tables"), columns.alias("n_columns"))


@query("join_02_link_by_substring", f"WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL} {LINKS_FROM_SL}")
def _(spark, sf):
    return L.link_by_substring(questions(spark, sf), catalog(spark, sf)).select("question_id", links_text().alias("links"))


def token_links_sql(q: str, cat: str, match: str) -> str:
    """Brute-force token links: every word of a question against every word of its database's names."""
    return f"""
qt AS (SELECT question_id, database_name, unnest(list_distinct({tokens_sql('question')})) AS qtok FROM {q}),
dq AS (SELECT DISTINCT database_name, qtok FROM qt),
ct AS (SELECT DISTINCT database_name, unnest({tokens_sql('column_name')}) AS etok, table_name, column_name FROM {cat}),
tt AS (SELECT DISTINCT database_name, unnest({tokens_sql('table_name')}) AS etok, table_name FROM {cat}),
de AS (SELECT DISTINCT database_name, etok FROM (SELECT database_name, etok FROM ct UNION ALL SELECT database_name, etok FROM tt)),
m AS (SELECT dq.database_name, qtok, etok FROM dq JOIN de ON dq.database_name = de.database_name AND {match}),
hc AS (SELECT DISTINCT question_id, ct.table_name, ct.column_name FROM qt JOIN m USING (database_name, qtok) JOIN ct USING (database_name, etok)),
ht AS (SELECT DISTINCT question_id, database_name, tt.table_name FROM qt JOIN m USING (database_name, qtok) JOIN tt USING (database_name, etok)),
tp AS (SELECT database_name, table_name, min(table_pos) AS table_pos FROM {cat} GROUP BY 1, 2),
al AS (SELECT question_id, table_name, column_name FROM hc
    UNION ALL SELECT ht.question_id, ht.table_name, c.column_name FROM ht JOIN {cat} c USING (database_name, table_name)
        WHERE (ht.question_id, ht.table_name) NOT IN (SELECT (question_id, table_name) FROM hc)),
tl AS (SELECT al.question_id, al.table_name, any_value(tp.table_pos) AS table_pos, string_agg(al.column_name, '|' ORDER BY c.column_pos) AS cols
    FROM al JOIN {q} q USING (question_id) JOIN tp ON tp.database_name = q.database_name AND tp.table_name = al.table_name
    JOIN {cat} c ON c.database_name = q.database_name AND c.table_name = al.table_name AND c.column_name = al.column_name
    GROUP BY 1, 2),
token_links AS (SELECT q.question_id, coalesce(string_agg(table_name || '(' || cols || ')', ';' ORDER BY table_pos), '()') AS links
    FROM {q} q LEFT JOIN tl USING (question_id) GROUP BY 1)"""


@query("join_03_link_by_tokens", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {token_links_sql('questions', 'catalog', 'qtok = etok')} SELECT * FROM token_links""")
def _(spark, sf):
    return L.link_by_tokens(stored_questions(spark, sf), catalog(spark, sf)).select("question_id", links_text().alias("links"))


@query("join_03_link_by_tokens_texts", f"""
WITH {TURNS_SQL}, {WORD_CATALOG_SQL}, {token_links_sql('turns', 'wcat', 'qtok = etok')} SELECT * FROM token_links""")
def _(spark, sf):
    return L.link_by_tokens(turns(spark, sf), word_catalog(spark, sf)).select("question_id", links_text().alias("links"))


@query("join_03_link_by_edit_distance", f"""
WITH {TURNS_SQL}, {WORD_CATALOG_SQL}, {token_links_sql('turns', 'wcat', 'levenshtein(qtok, etok) <= 1')} SELECT * FROM token_links""")
def _(spark, sf):
    return L.link_by_tokens(turns(spark, sf), word_catalog(spark, sf), edit_distance=1).select(
        "question_id", links_text().alias("links")
    )


def similar_words_sql(distance: int) -> str:
    return f"""
WITH {TURNS_SQL}, {WORD_CATALOG_SQL},
l AS (SELECT DISTINCT unnest({tokens_sql('question', 1)}) AS left_token FROM turns),
r AS (SELECT DISTINCT unnest({tokens_sql('column_name', 1)}) AS right_token FROM wcat UNION SELECT DISTINCT unnest({tokens_sql('table_name', 1)}) FROM wcat)
SELECT left_token, right_token FROM l JOIN r ON abs(len(left_token) - len(right_token)) <= {distance} AND levenshtein(left_token, right_token) <= {distance}"""


def similar_words(distance: int):
    def run(spark, sf):
        words = turns(spark, sf).select("database_name", F.explode(F.array_distinct(link_tokens(F.col("question"), 1))).alias("token"))
        return L.similar_tokens(words, L.entity_tokens(word_catalog(spark, sf), 1), distance).select("left_token", "right_token")

    return run


for _distance in (1, 2, 3):
    query(f"join_03_similar_words_{_distance}", similar_words_sql(_distance))(similar_words(_distance))


@query("join_05_link_from_pairs", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
p AS (SELECT question_id, database_name, lower(a) AS table_name, lower(b) AS column_name FROM (SELECT question_id, database_name,
        unnest([string_split(sql_query, ' ')[5], string_split(sql_query, ' ')[5], 'Ghost']) AS a,
        unnest([string_split(sql_query, ' ')[7], 'nothing', 'x']) AS b FROM questions)),
tb AS (SELECT DISTINCT database_name, table_name, table_pos FROM catalog),
kt AS (SELECT DISTINCT question_id, p.database_name, p.table_name FROM p JOIN tb USING (database_name, table_name)),
hit AS (SELECT DISTINCT p.question_id, p.table_name, c.column_name, c.column_pos FROM p JOIN catalog c USING (database_name, table_name, column_name)),
full_cols AS (SELECT kt.question_id, kt.table_name, c.column_name, 1 AS part, c.column_pos FROM kt JOIN catalog c USING (database_name, table_name)
    WHERE (kt.question_id, kt.table_name) NOT IN (SELECT (question_id, table_name) FROM hit)),
key_cols AS (SELECT h.question_id, h.table_name, c.column_name, 1 AS part, c.column_pos
    FROM (SELECT DISTINCT question_id, table_name FROM hit) h JOIN questions q USING (question_id)
    JOIN catalog c ON c.database_name = q.database_name AND c.table_name = h.table_name AND (c.is_primary_key OR c.is_foreign_key)
    WHERE (h.question_id, h.table_name, c.column_name) NOT IN (SELECT (question_id, table_name, column_name) FROM hit)),
al AS (SELECT question_id, table_name, column_name, 0 AS part, column_pos FROM hit UNION ALL SELECT * FROM full_cols UNION ALL SELECT * FROM key_cols)
SELECT q.question_id, coalesce(any_value(l.links), '') AS links FROM questions q LEFT JOIN (
    SELECT question_id, table_name || '(' || string_agg(column_name, '|' ORDER BY part, column_pos) || ')' AS links FROM al GROUP BY question_id, table_name) l
    USING (question_id) GROUP BY q.question_id""")
def _(spark, sf):
    from nlsql_spark.operators.schema_text import link_from_pairs

    words = F.split("sql_query", " ")
    pair = lambda t, c: F.struct(t.alias("table_name"), c.alias("column_name"))
    replies = questions(spark, sf).select(
        "question_id", "database_name", "question",
        F.array(
            pair(F.upper(words[4]), words[6]), pair(F.upper(words[4]), F.lit("nothing")), pair(F.lit("Ghost"), F.lit("x"))
        ).alias("pairs"),
    )
    return link_from_pairs(replies, catalog(spark, sf)).select("question_id", links_text().alias("links"))


@query("join_11_resolve_foreign_keys", f"WITH {CATALOG_SQL}, {KEYS_SQL} SELECT * FROM keys")
def _(spark, sf):
    return keys(spark, sf)


@query("join_15_resolve_columns", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
t AS (SELECT question_id, database_name, string_split(sql_query, ' ') AS w FROM questions),
known AS (SELECT question_id, w[5] AS table_name, rtrim(w[2], ',') AS column_name FROM t),
bare AS (SELECT t.question_id, c.table_name, c.column_name FROM t JOIN catalog c ON c.database_name = t.database_name
    AND c.table_name = t.w[5] AND c.column_name = t.w[7])
SELECT * FROM known UNION SELECT * FROM bare""")
def _(spark, sf):
    w = F.split("sql_query", " ")
    q = stored_questions(spark, sf)
    used = q.select("question_id", "database_name", w[4].alias("name"), F.lit("t1").alias("alias"))
    columns = q.select("question_id", "database_name", F.lit("t1").alias("qualifier"), F.rtrim(w[1], F.lit(",")).alias("column_name")).unionByName(
        q.select("question_id", "database_name", F.lit("").alias("qualifier"), F.upper(w[6]).alias("column_name"))
    )
    return C.resolve_columns(used, columns, catalog(spark, sf))


@query("join_15_scoped_columns", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL},
other AS (SELECT a.database_name, a.table_name, min(b.table_name) AS other_table FROM catalog a JOIN catalog b ON a.database_name = b.database_name AND b.table_name <> a.table_name GROUP BY 1, 2),
lead AS (SELECT database_name, table_name, arg_min(column_name, column_pos) AS other_column FROM catalog GROUP BY 1, 2),
t AS (SELECT question_id, database_name, string_split(sql_query, ' ')[5] AS table_name, rtrim(string_split(sql_query, ' ')[2], ',') AS column_name FROM questions),
u AS (SELECT t.*, other_table, other_column FROM t JOIN other USING (database_name, table_name)
    JOIN lead ON lead.database_name = t.database_name AND lead.table_name = other_table)
SELECT question_id, 0 AS scope_id, 'd' AS qualifier, 'shown' AS column_name, table_name, column_name AS source_column FROM u
UNION SELECT question_id, 2, 'd', 'shown', table_name, column_name FROM u
UNION SELECT question_id, 1, 'x', column_name, table_name, column_name FROM u
UNION SELECT question_id, 0, 'x', other_column, other_table, other_column FROM u
UNION SELECT question_id, 2, 'x', other_column, other_table, other_column FROM u""")
def _(spark, sf):
    """SELECT d.shown, x.c FROM (SELECT x.col AS shown FROM t x) d, other x WHERE EXISTS (SELECT d.shown, x.c FROM t y): x is two tables."""
    from nlsql_spark.operators.scopes import resolve_scoped_columns

    c, w = catalog(spark, sf), F.split("sql_query", " ")
    names = c.select("database_name", "table_name").distinct()
    rest = names.withColumnRenamed("table_name", "other_table")
    other = names.join(rest, "database_name").filter("other_table <> table_name").groupBy("database_name", "table_name").agg(F.min("other_table").alias("other_table"))
    lead = c.groupBy("database_name", F.col("table_name").alias("other_table")).agg(F.min_by("column_name", "column_pos").alias("other_column"))
    used = questions(spark, sf).select("question_id", "database_name", w[4].alias("table_name"), F.rtrim(w[1], F.lit(",")).alias("column_name"))
    u = materialize(used.join(other, ["database_name", "table_name"]).join(lead, ["database_name", "other_table"]))
    rows = lambda *parts: reduce(DataFrame.unionByName, [u.select("question_id", *[(x if hasattr(x, "alias") else F.lit(x)).alias(n) for n, x in p.items()]) for p in parts])
    none, t, o = F.lit(None).cast("int"), F.col("table_name"), F.col("other_table")
    scopes = rows({"scope_id": 0, "parent_id": none}, {"scope_id": 1, "parent_id": 0}, {"scope_id": 2, "parent_id": 0})
    db = {"database_name": F.col("database_name")}
    bindings = rows(
        {**db, "scope_id": 0, "name": "d", "alias": "", "inner_scope": 1}, {**db, "scope_id": 0, "name": o, "alias": "x", "inner_scope": none},
        {**db, "scope_id": 1, "name": t, "alias": "x", "inner_scope": none}, {**db, "scope_id": 2, "name": t, "alias": "y", "inner_scope": none},
    )
    outputs = rows({"scope_id": 1, "output_name": "shown", "qualifier": "x", "column_name": F.col("column_name")})
    columns = rows(
        {"scope_id": 0, "qualifier": "d", "column_name": "shown"}, {"scope_id": 2, "qualifier": "d", "column_name": "shown"}, {"scope_id": 1, "qualifier": "x", "column_name": F.col("column_name")},
        {"scope_id": 0, "qualifier": "x", "column_name": F.col("other_column")}, {"scope_id": 2, "qualifier": "x", "column_name": F.col("other_column")},
    )
    return resolve_scoped_columns(scopes, bindings, outputs, columns, c)


@query("agg_01_columns_per_table", f"""
WITH {CATALOG_SQL} SELECT database_name, table_name, any_value(table_pos) AS table_pos, string_agg(column_name, '|' ORDER BY column_pos) AS columns
FROM catalog GROUP BY 1, 2""")
def _(spark, sf):
    t = C.columns_per_table(catalog(spark, sf))
    return t.withColumn("columns", F.array_join(F.transform("columns", lambda c: c["column_name"]), "|"))


@query("agg_17_identifier_pool", f"""
WITH {CATALOG_SQL}, a AS (SELECT database_name, string_agg(DISTINCT table_name, '|' ORDER BY table_name) AS tables,
    string_agg(DISTINCT column_name, '|' ORDER BY column_name) AS columns FROM catalog GROUP BY 1) SELECT * FROM a""")
def _(spark, sf):
    p = C.identifier_pool(catalog(spark, sf))
    return p.select("database_name", F.array_join("tables", "|").alias("tables"), F.array_join("columns", "|").alias("columns"))


@query("src_05_catalog_columns", f"""
WITH {CATALOG_SQL} SELECT database_name, table_name, column_name, is_primary_key, is_foreign_key, data_format FROM catalog""")
def _(spark, sf):
    """The catalogue packed as catalogue-file entries and read back."""
    from nlsql_spark.sources.files import catalog_columns

    nested = C.nest_catalog(catalog(spark, sf))
    flat = nested.withColumn(
        "cols",
        F.flatten(F.transform("tables", lambda t, i: F.transform(t["columns"], lambda c: F.struct(i.alias("t"), c.alias("c"))))),
    )
    star = F.array(F.array(F.lit("-1"), F.lit("*")))
    where = lambda flag: F.array_compact(F.transform("cols", lambda c, i: F.when(c["c"][flag], i + 1)))
    entries = flat.select(
        F.col("database_name").alias("db_id"),
        F.transform("tables", lambda t: F.upper(t["table_name"])).alias("table_names_original"),
        F.concat(star, F.transform("cols", lambda c: F.array(c["t"].cast("string"), F.initcap(c["c"]["column_name"])))).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.transform("cols", lambda c: c["c"]["data_format"])).alias("column_types"),
        F.transform(where("is_primary_key"), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))).alias("primary_keys"),
        F.transform(where("is_foreign_key"), lambda i: F.array(i)).alias("foreign_keys"),
    )
    return catalog_columns(entries).select("database_name", "table_name", "column_name", "is_primary_key", "is_foreign_key", "data_format")


# links of an order: table = return flag, column = line number; predictions are open lines and, for
# large quantities, the next line number
TRUTH_SQL = "truth AS (SELECT DISTINCT l_orderkey AS question_id, l_returnflag AS table_name, l_linenumber::VARCHAR AS column_name FROM lineitem)"
PRED_SQL = """pred AS (SELECT l_orderkey AS question_id, l_returnflag AS table_name, l_linenumber::VARCHAR AS column_name FROM lineitem WHERE l_linestatus = 'O'
    UNION SELECT l_orderkey, l_returnflag, (l_linenumber + 1)::VARCHAR FROM lineitem WHERE l_quantity > 40)"""
COUNTS_SQL = """both_sides AS (SELECT coalesce(p.question_id, t.question_id) AS question_id, count(p.question_id) AS n_pred, count(t.question_id) AS n_truth,
    count(CASE WHEN p.question_id IS NOT NULL AND t.question_id IS NOT NULL THEN 1 END) AS n_both
    FROM pred p FULL JOIN truth t ON p.question_id = t.question_id AND p.table_name = t.table_name AND p.column_name = t.column_name GROUP BY 1)"""
FPR_SQL = "round(coalesce((sum(n_pred) - sum(n_both))::DOUBLE / nullif(sum(n_pred), 0)::DOUBLE, 0), 6) AS false_positive_rate"
RECALL_SQL = "round(avg((n_both = n_truth)::INTEGER), 6) AS recall"
COLUMN_SQL = "round(avg(n_both::DOUBLE / nullif(n_truth, 0)), 6) AS column_recall"


def truth_links(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("table_name"),
        F.col("l_linenumber").cast("string").alias("column_name"),
    )


def pred_links(spark, sf):
    line = table(spark, sf, "lineitem")
    link = lambda df, c: df.select(
        F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("table_name"), c.cast("string").alias("column_name")
    )
    return link(line.filter("l_linestatus = 'O'"), F.col("l_linenumber")).unionByName(
        link(line.filter("l_quantity > 40"), F.col("l_linenumber") + 1)
    )


@query("agg_07_link_fpr", f"WITH {TRUTH_SQL}, {PRED_SQL}, {COUNTS_SQL} SELECT {FPR_SQL} FROM both_sides")
def _(spark, sf):
    return M.link_fpr(pred_links(spark, sf), truth_links(spark, sf)).select(F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query("agg_08_link_recall", f"WITH {TRUTH_SQL}, {PRED_SQL}, {COUNTS_SQL} SELECT {RECALL_SQL} FROM both_sides")
def _(spark, sf):
    return M.link_recall(pred_links(spark, sf), truth_links(spark, sf)).select(F.round("recall", 6).alias("recall"))


@query("agg_09_column_recall", f"WITH {TRUTH_SQL}, {PRED_SQL}, {COUNTS_SQL} SELECT {COLUMN_SQL}, count(CASE WHEN n_truth = 0 THEN 1 END) AS without_truth FROM both_sides")
def _(spark, sf):
    return M.column_recall(pred_links(spark, sf), truth_links(spark, sf)).withColumn("column_recall", F.round("column_recall", 6))


@query("agg_10_link_metrics", f"WITH {TRUTH_SQL}, {PRED_SQL}, {COUNTS_SQL} SELECT {FPR_SQL}, {RECALL_SQL}, {COLUMN_SQL}, count(*) AS questions FROM both_sides")
def _(spark, sf):
    m = M.link_metrics(pred_links(spark, sf), truth_links(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in ("false_positive_rate", "recall", "column_recall")], "questions")


@query("set_01_link_set_ops", f"""
WITH {TRUTH_SQL}, {PRED_SQL}
SELECT coalesce(p.question_id, t.question_id) AS question_id, coalesce(p.table_name, t.table_name) AS table_name,
    coalesce(p.column_name, t.column_name) AS column_name, p.question_id IS NOT NULL AS in_pred, t.question_id IS NOT NULL AS in_truth
FROM pred p FULL JOIN truth t ON p.question_id = t.question_id AND p.table_name = t.table_name AND p.column_name = t.column_name""")
def _(spark, sf):
    return M.link_set_ops(pred_links(spark, sf), truth_links(spark, sf))


@query("set_02_missing_keys", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}
SELECT sl.question_id, sl.table_name, c.column_name FROM sl JOIN questions q USING (question_id) JOIN catalog c
    ON c.database_name = q.database_name AND c.table_name = sl.table_name AND (c.is_primary_key OR c.is_foreign_key)
WHERE NOT list_contains(sl.columns, c.column_name)""")
def _(spark, sf):
    from nlsql_spark.operators.schema_text import repair_links

    q, c = stored_questions(spark, sf), catalog(spark, sf)
    linked = L.link_by_substring(q, c).join(q.select("question_id", "database_name"), "question_id")
    mended = repair_links(linked.withColumn("old", F.col("schema_links")), c)
    added = F.filter(
        F.zip_with("schema_links", "old", lambda new, old: F.struct(new["table_name"].alias("t"), F.array_except(new["columns"], old["columns"]).alias("c"))),
        lambda x: F.size(x["c"]) > 0,
    )
    flat = mended.select("question_id", F.inline(added))
    return flat.select("question_id", F.col("t").alias("table_name"), F.explode("c").alias("column_name"))


@query("join_13_assert_same_ids", "SELECT DISTINCT l_orderkey AS question_id FROM lineitem")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"))
    return M.assert_same_ids(ids, ids.distinct().join(ids.withColumnRenamed("question_id", "q"), F.col("question_id") == F.col("q")).drop("q"))


@query("job_02_ground_truth_links", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}
SELECT question_id, table_name, unnest(columns) AS column_name FROM sl""")
def _(spark, sf):
    return L.links_flat(L.link_by_substring(questions(spark, sf), catalog(spark, sf)))


@query("job_11_link_scoring", f"""
WITH {CATALOG_SQL}, {QUESTIONS_SQL}, {SUBSTRING_SQL}, {token_links_sql('questions', 'catalog', 'qtok = etok')},
truth AS (SELECT question_id, table_name, unnest(columns) AS column_name FROM sl),
pred AS (SELECT question_id, table_name, column_name FROM al), {COUNTS_SQL},
every AS (SELECT q.question_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_truth, 0) AS n_truth, coalesce(n_both, 0) AS n_both
    FROM questions q LEFT JOIN both_sides USING (question_id))
SELECT {FPR_SQL}, {RECALL_SQL}, {COLUMN_SQL}, count(*) AS questions FROM every""")
def _(spark, sf):
    m = link_report(stored_questions(spark, sf), catalog(spark, sf))
    return m.select(*[F.round(x, 6).alias(x) for x in ("false_positive_rate", "recall", "column_recall")], "questions")
