"""Inputs of the registered queries, derived from the given tables; each with its SQL twin.

catalogue   parts as a schema catalogue: brand = database, type = table, name = column
keys        first column(s) of a table = primary key, last = foreign key to the next table
questions   one per order of lineitem: two of its parts give question, query, knowledge and steps
turns       conversation turns as questions; words of the benchmark texts as their catalogue
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.operators.catalog import resolve_foreign_keys
from nlsql_spark.session import materialize, spread

DB = "corpus"
LONG_TEXTS = ["documents", "conversations"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(scan) if name in LONG_TEXTS else scan


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    columns = part.groupBy(
        F.lower(F.translate("p_brand", "#", "_")).alias("database_name"),
        F.lower("p_type").alias("table_name"),
        F.translate("p_name", " ", "_").alias("column_name"),
    ).agg(F.min("p_partkey").alias("column_pos"))
    one = Window.partitionBy("database_name", "table_name")
    return columns.withColumns(
        {
            "rn": F.row_number().over(one.orderBy("column_pos")),
            "n": F.count("*").over(one),
            "table_pos": F.min("column_pos").over(one),
            "first_column": F.min_by("column_name", "column_pos").over(one),
        }
    )


CATALOG_TYPED = "CASE column_pos % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' WHEN 2 THEN 'date' WHEN 3 THEN 'datetime' ELSE 'text' END"


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue is a stored table: it is derived once and then read by every step that needs it."""
    return materialize(_catalog(spark, sf))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select(
        "database_name", "table_name", "table_pos", "column_name", "column_pos",
        F.expr(CATALOG_TYPED).alias("data_format"),
        F.when(F.col("column_pos") % 7 == 0, F.lit("0")).alias("default_value"),
        (F.col("column_pos") % 3 == 0).alias("is_not_null"),
        ((F.col("rn") == 1) | ((F.col("rn") == 2) & (F.col("n") % 2 == 0))).alias("is_primary_key"),
        ((F.col("rn") == F.col("n")) & (F.col("n") >= 3)).alias("is_foreign_key"),
    )


def raw_keys(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _ranked(spark, sf)
    pk = ranked.filter("rn = 1 or (rn = 2 and n % 2 = 0)").select(
        "database_name", "table_name", F.lit(0).alias("constraint_id"), F.lit("pk").alias("kind"),
        (F.col("rn") - 1).alias("seq"), F.col("column_name").alias("local_column"),
        F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_column"),
    )
    tables = ranked.filter("rn = 1").select("database_name", "table_name", "first_column")
    order = Window.partitionBy("database_name").orderBy("table_name")
    following = tables.select(
        "database_name", "table_name",
        F.coalesce(F.lead("table_name").over(order), F.col("table_name")).alias("ref_table"),
        F.coalesce(F.lead("first_column").over(order), F.col("first_column")).alias("ref_first"),
    )
    fk = ranked.filter("rn = n and n >= 3").join(following, ["database_name", "table_name"]).select(
        "database_name", "table_name", F.lit(1).alias("constraint_id"), F.lit("fk").alias("kind"), F.lit(0).alias("seq"),
        F.col("column_name").alias("local_column"), "ref_table",
        F.when(F.col("column_pos") % 2 == 1, F.col("ref_first")).alias("ref_column"),
    )
    return pk.unionByName(fk)


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(resolve_foreign_keys(raw_keys(spark, sf)))


CATALOG_SQL = f"""
cat0 AS (SELECT lower(replace(p_brand, '#', '_')) AS database_name, lower(p_type) AS table_name,
    replace(p_name, ' ', '_') AS column_name, min(p_partkey) AS column_pos FROM part GROUP BY 1, 2, 3),
cat1 AS (SELECT *, row_number() OVER (PARTITION BY database_name, table_name ORDER BY column_pos) AS rn,
    count(*) OVER (PARTITION BY database_name, table_name) AS n,
    min(column_pos) OVER (PARTITION BY database_name, table_name) AS table_pos,
    arg_min(column_name, column_pos) OVER (PARTITION BY database_name, table_name) AS first_column FROM cat0),
catalog AS (SELECT database_name, table_name, table_pos, column_name, column_pos, {CATALOG_TYPED} AS data_format,
    CASE WHEN column_pos % 7 = 0 THEN '0' END AS default_value, column_pos % 3 = 0 AS is_not_null,
    (rn = 1 OR (rn = 2 AND n % 2 = 0)) AS is_primary_key, (rn = n AND n >= 3) AS is_foreign_key FROM cat1)"""

KEYS_SQL = """
tabs AS (SELECT database_name, table_name, first_column FROM cat1 WHERE rn = 1),
following AS (SELECT database_name, table_name,
    coalesce(lead(table_name) OVER w, table_name) AS ref_table,
    coalesce(lead(first_column) OVER w, first_column) AS ref_first
    FROM tabs WINDOW w AS (PARTITION BY database_name ORDER BY table_name)),
single_pk AS (SELECT database_name, table_name AS ref_table, first_column AS pk_column FROM cat1
    WHERE rn = 1 AND n % 2 = 1),
keys AS (
    SELECT database_name, table_name, 0 AS constraint_id, 'pk' AS kind, (rn - 1)::INTEGER AS seq, column_name AS local_column,
        NULL::VARCHAR AS ref_table, NULL::VARCHAR AS ref_column FROM cat1 WHERE rn = 1 OR (rn = 2 AND n % 2 = 0)
    UNION ALL
    SELECT c.database_name, c.table_name, 1, 'fk', 0, c.column_name, f.ref_table,
        CASE WHEN c.column_pos % 2 = 1 THEN f.ref_first ELSE s.pk_column END
    FROM cat1 c JOIN following f USING (database_name, table_name)
    LEFT JOIN single_pk s ON s.database_name = f.database_name AND s.ref_table = f.ref_table
    WHERE c.rn = c.n AND c.n >= 3 AND (c.column_pos % 2 = 1 OR s.pk_column IS NOT NULL))"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    orders = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("question_id"))
        .agg(
            F.min("l_partkey").alias("pa"), F.max("l_partkey").alias("pb"), F.count("*").alias("n_lines"),
            F.min("l_linenumber").alias("first_line"), F.chr(F.min(F.ascii("l_returnflag"))).alias("flag"),
        )
    )
    part = table(spark, sf, "part")
    a = part.select(
        F.col("p_partkey").alias("pa"), F.lower(F.translate("p_brand", "#", "_")).alias("database_name"),
        F.col("p_name").alias("name_a"), F.lower("p_type").alias("type_a"), F.col("p_size").alias("size_a"),
    )
    b = part.select(
        F.col("p_partkey").alias("pb"), F.col("p_name").alias("name_b"), F.lower("p_type").alias("type_b"),
        F.col("p_size").alias("size_b"),
    )
    q = orders.join(a, "pa").join(b, "pb")
    col_a, col_b = F.translate("name_a", " ", "_"), F.translate("name_b", " ", "_")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    steps = F.array(
        text("Use table `", F.col("type_a"), "`."),
        text("Filter `", col_b, "` > ", F.col("size_b").cast("string"), "."),
        text("Group by `", col_a, "`."),
        text("Select `", col_a, "`."),
        F.lit("Count the rows."),
        F.lit("Order by the count."),
    )
    return q.select(
        "question_id",
        "database_name",
        text("how many ", F.col("name_b"), " per ", F.col("name_a"), " in ", F.col("type_a"), " with size ", F.col("size_a").cast("string"), "?").alias("question"),
        text("SELECT ", col_a, ", count(*) FROM ", F.col("type_a"), " WHERE ", col_b, " > ", F.col("size_b").cast("string"), " GROUP BY ", col_a).alias("sql_query"),
        F.when(F.col("flag") == "A", F.lit("")).when(F.col("flag") == "N", text(F.col("name_b"), " refers to ", F.col("type_b"))).alias("knowledge"),
        F.when(F.col("n_lines") <= 2, F.lit("simple")).when(F.col("n_lines") <= 4, F.lit("moderate")).otherwise(F.lit("challenging")).alias("difficulty"),
        F.slice(steps, F.lit(1), F.lit(2) + F.least(F.col("n_lines"), F.lit(4)).cast("int")).alias("reasoning_steps"),
        "first_line",
    )


QUESTIONS_SQL = """
qo AS (SELECT l_orderkey AS question_id, min(l_partkey) AS pa, max(l_partkey) AS pb, count(*) AS n_lines,
    min(l_linenumber) AS first_line, min(l_returnflag) AS flag FROM lineitem GROUP BY 1),
q1 AS (SELECT qo.*, lower(replace(a.p_brand, '#', '_')) AS database_name, a.p_name AS name_a, lower(a.p_type) AS type_a,
    a.p_size AS size_a, b.p_name AS name_b, lower(b.p_type) AS type_b, b.p_size AS size_b,
    replace(a.p_name, ' ', '_') AS col_a, replace(b.p_name, ' ', '_') AS col_b
    FROM qo JOIN part a ON a.p_partkey = pa JOIN part b ON b.p_partkey = pb),
questions AS (SELECT question_id, database_name,
    'how many ' || name_b || ' per ' || name_a || ' in ' || type_a || ' with size ' || size_a || '?' AS question,
    'SELECT ' || col_a || ', count(*) FROM ' || type_a || ' WHERE ' || col_b || ' > ' || size_b || ' GROUP BY ' || col_a AS sql_query,
    CASE flag WHEN 'A' THEN '' WHEN 'N' THEN name_b || ' refers to ' || type_b END AS knowledge,
    CASE WHEN n_lines <= 2 THEN 'simple' WHEN n_lines <= 4 THEN 'moderate' ELSE 'challenging' END AS difficulty,
    list_slice(['Use table `' || type_a || '`.', 'Filter `' || col_b || '` > ' || size_b || '.', 'Group by `' || col_a || '`.',
        'Select `' || col_a || '`.', 'Count the rows.', 'Order by the count.'], 1, 2 + least(n_lines, 4)) AS reasoning_steps,
    first_line FROM q1)"""


def stored_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The questions as a written table, for queries that read them several times."""
    return materialize(questions(spark, sf))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.lit(DB).alias("database_name"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("knowledge"), "role", "conv_id", "turn",
    )


def word_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The longer words of the benchmark texts: a word is a column, its first text the table."""
    words = table(spark, sf, "benchmark").select(
        "item_id", F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +")).alias("column_name")
    )
    columns = words.filter(F.length("column_name") >= 4).groupBy("column_name").agg(F.min("item_id").alias("item_id"))
    return columns.select(
        F.lit(DB).alias("database_name"), F.concat(F.lit("text_"), F.col("item_id")).alias("table_name"),
        F.col("item_id").alias("table_pos"), "column_name", F.xxhash64("column_name").alias("column_pos"),
    ).withColumn("column_pos", F.row_number().over(Window.partitionBy("table_name").orderBy("column_name")))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"


def link_text_sql(c: str) -> str:
    return rf"regexp_replace(translate(lower({c}), '_-', '  '), '[^a-z0-9\s]', '', 'g')"


def tokens_sql(c: str, least: int = 3) -> str:
    text = link_text_sql(c)
    for word, at in K.SPLIT_WORDS.items():
        text = rf"regexp_replace({text}, '\b({word[:at]})({word[at:]})\b', '\1 \2', 'g')"
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: len(w) >= {least} AND w NOT IN {STOP_SQL})"


TURNS_SQL = f"""
turns AS (SELECT conv_id * 1000 + turn AS question_id, '{DB}' AS database_name, text AS question, role, conv_id, turn
    FROM conversations)"""

WORD_CATALOG_SQL = f"""
w0 AS (SELECT item_id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +')) AS column_name FROM benchmark),
w1 AS (SELECT column_name, min(item_id) AS item_id FROM w0 WHERE len(column_name) >= 4 GROUP BY 1),
wcat AS (SELECT '{DB}' AS database_name, 'text_' || item_id AS table_name, item_id AS table_pos, column_name,
    row_number() OVER (PARTITION BY item_id ORDER BY column_name) AS column_pos FROM w1)"""


def uniform_sql(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


# links of questions by substring, in catalogue order: question_id, table_name, table_pos, columns
SUBSTRING_SQL = """
sl AS (SELECT q.question_id, c.table_name, min(c.table_pos) AS table_pos, list(c.column_name ORDER BY c.column_name) AS columns
    FROM questions q JOIN catalog c ON c.database_name = q.database_name
        AND contains(lower(q.sql_query), lower(c.table_name)) AND contains(lower(q.sql_query), lower(c.column_name))
    GROUP BY q.question_id, c.table_name)"""


def links_text(col: str = "schema_links"):
    """Links as text ``table(col|col);table(...)``."""
    return F.array_join(
        F.transform(col, lambda x: F.concat(x["table_name"], F.lit("("), F.array_join(x["columns"], "|"), F.lit(")"))), ";"
    )
