from pyspark.sql import functions as F

from nlsql_spark.operators.catalog import (
    KEYS_SCHEMA, columns_per_table, flag_keys, identifier_pool, introspect, nest_catalog, resolve_columns,
    resolve_foreign_keys,
)
from nlsql_spark.operators.linking import LINKS_TYPE
from nlsql_spark.operators.name_index import links_array
from nlsql_spark.operators.schema_text import apply_links, ddl_text, render_ddl, sample_rows_per_group, sample_rows_text
from tests.conftest import CATALOG

ROWS = [
    ("db", "person", 0, "id", 0, "integer", None, True, True, False),
    ("db", "person", 0, "name", 1, "text", "'x'", False, False, False),
    ("db", "visit", 1, "person_id", 2, "integer", None, False, True, True),
    ("db", "visit", 1, "day", 3, "date", None, False, True, False),
]
KEYS = [
    ("db", "person", 0, "pk", 0, "id", None, None),
    ("db", "visit", 0, "pk", 0, "day", None, None),
    ("db", "visit", 0, "pk", 1, "person_id", None, None),
    ("db", "visit", 1, "fk", 0, "person_id", "person", "id"),
]


def _ddl(spark, links=None, **options):
    nested = nest_catalog(spark.createDataFrame(ROWS, CATALOG), spark.createDataFrame(KEYS, KEYS_SCHEMA))
    column = None if links is None else F.col("l")
    df = nested if links is None else nested.crossJoin(spark.createDataFrame([(links,)], f"l {LINKS_TYPE}"))
    return df.select(ddl_text(F.col("tables"), column, **options)).first()[0]


PERSON = "CREATE TABLE `person`\n(\n`id` INTEGER  not null  PRIMARY KEY,\n`name` TEXT  default 'x'  null\n);"
VISIT = "CREATE TABLE `visit`\n(\n`person_id` INTEGER  null,\n`day` DATE  null"
FK = ",\nFOREIGN KEY (`person_id`) REFERENCES `person` (`id`)"
PK = ",\nPRIMARY KEY (`day`, `person_id`)"


def test_full_ddl_has_no_key_lines(spark):
    assert _ddl(spark) == PERSON + "\n\n" + VISIT + "\n);"
    assert _ddl(spark, all_constraints=True) == PERSON + "\n\n" + VISIT + FK + PK + "\n);"


def test_linked_ddl(spark):
    assert _ddl(spark, [("visit", ["day", "person_id"])]) == VISIT + FK + PK + "\n);"
    assert _ddl(spark, [("visit", ["day"])]) == "CREATE TABLE `visit`\n(\n`day` DATE  null\n);"
    # a table named twice keeps its first place and its last columns
    twice = _ddl(spark, [("person", ["name"]), ("visit", ["day"]), ("person", ["id"])])
    assert twice.startswith("CREATE TABLE `person`\n(\n`id` INTEGER  not null  PRIMARY KEY\n);\n\nCREATE TABLE `visit`")
    both = _ddl(spark, [("person", ["name"]), ("person", ["id"])], union_links=True)
    assert both == PERSON


def test_shuffled_columns_are_a_permutation(spark):
    out = [_ddl(spark, shuffle_seed=s) for s in range(6)]
    lines = {"\n".join(sorted(o.replace(",\n", "\n").split("\n"))) for o in out}
    assert len(lines) == 1 and len(set(out)) > 1 and _ddl(spark, shuffle_seed=3) == out[3]


def test_sample_rows(spark):
    df = spark.createDataFrame([(["id", "name"], [["1", "Al"], ["20", None]])], "n array<string>, r array<array<string>>")
    assert df.select(sample_rows_text(F.col("n"), F.col("r"))).first()[0] == "id name \n 1   Al \n20 None "
    examples = spark.createDataFrame([("db", "person", 1, ["1", "Al"])], "database_name string, table_name string, row_no int, values array<string>")
    text = render_ddl(spark.createDataFrame(ROWS[:2], CATALOG), None, examples).first()["database_schema"]
    assert text == PERSON + " \n /* \n 1 example rows: \n SELECT * FROM person LIMIT 1; \n id name \n 1   Al  \n */"
    top = sample_rows_per_group(spark.range(10).withColumn("g", F.col("id") % 2), ["g"], ["id"], 2)
    assert sorted(r["id"] for r in top.collect()) == [0, 1, 2, 3]


def test_apply_links_keeps_old_text_without_links(spark):
    catalog, keys = spark.createDataFrame(ROWS, CATALOG), spark.createDataFrame(KEYS, KEYS_SCHEMA)
    questions = spark.createDataFrame([(1, "db", "old"), (2, "db", "old"), (3, "db", "old")], "question_id long, database_name string, database_schema string")
    links = spark.createDataFrame([(1, [("visit", ["day"])]), (2, [("ghost", ["x"])])], f"question_id long, schema_links {LINKS_TYPE}")
    got = {r["question_id"]: r["database_schema"] for r in apply_links(questions, links, catalog, keys).collect()}
    assert got == {1: VISIT + FK + PK + "\n);", 2: "old", 3: "old"}
    raw = {r["question_id"]: r["database_schema"] for r in apply_links(questions.filter("question_id = 1"), links, catalog, keys, repair=False).collect()}
    assert raw == {1: "CREATE TABLE `visit`\n(\n`day` DATE  null\n);"}


def test_keys(spark):
    rows = [
        ("db", "a", 0, "pk", 0, "id", None, None),
        ("db", "b", 0, "pk", 0, "x", None, None),
        ("db", "b", 0, "pk", 1, "y", None, None),
        ("db", "c", 1, "fk", 0, "A_Ref", "A", None),
        ("db", "c", 2, "fk", 0, "b_ref", "b", None),
        ("db", "c", 3, "fk", 0, "p", "b", "x"),
        ("db", "c", 3, "fk", 1, "q", "b", "y"),
        ("db", "c", 4, "fk", 0, "p", "a", None),
        ("db", "c", 4, "fk", 1, "q", "a", None),
    ]
    out = resolve_foreign_keys(spark.createDataFrame(rows, KEYS_SCHEMA)).filter("kind = 'fk'")
    got = sorted((r["constraint_id"], r["local_column"], r["ref_table"], r["ref_column"]) for r in out.collect())
    assert got == [(1, "a_ref", "a", "id"), (3, "p", "b", "x"), (3, "q", "b", "y")]


def test_introspect_and_pools(spark):
    tables = {"Person": spark.createDataFrame([(1, "a")], "Id long, name string"), "sqlite_sequence": spark.range(1)}
    keys = spark.createDataFrame([("db", "person", 0, "pk", 0, "ID", None, None)], KEYS_SCHEMA)
    flat = introspect(spark, tables, "db", keys)
    rows = sorted((r["table_name"], r["column_pos"], r["column_name"], r["data_format"], r["is_primary_key"]) for r in flat.collect())
    assert rows == [("person", 0, "id", "bigint", True), ("person", 1, "name", "string", False)]
    assert flag_keys(flat, keys).count() == 2
    assert identifier_pool(flat).first()["columns"] == ["id", "name"]
    assert [c["column_name"] for c in columns_per_table(flat).first()["columns"]] == ["id", "name"]


def test_resolve_columns(spark, make_catalog):
    catalog = make_catalog({"person": ["name", "age"], "animal": ["name", "owner"], "plant": ["age"]})
    tables = spark.createDataFrame([(1, "db", "person", "p"), (1, "db", "animal", "")], "question_id long, database_name string, name string, alias string")
    columns = spark.createDataFrame(
        [(1, "db", "p", "Age"), (1, "db", "animal", "owner"), (1, "db", "", "name"), (1, "db", "zz", "age")],
        "question_id long, database_name string, qualifier string, column_name string",
    )
    got = sorted((r["table_name"], r["column_name"]) for r in resolve_columns(tables, columns, catalog).collect())
    assert got == [("animal", "name"), ("animal", "owner"), ("person", "age"), ("person", "name")]


def test_sample_rows_reach_the_prompt(spark, make_catalog):
    from nlsql_spark.operators.schema_text import apply_links, render_ddl
    from nlsql_spark.plans.jobs import schema_prompts

    catalog = make_catalog({"person": ["name", "age"], "pet": ["kind"]})
    examples = spark.createDataFrame([("db", "person", 0, ["Ann", "7"]), ("db", "person", 1, ["Bo", None])], "database_name string, table_name string, row_no int, values array<string>")
    whole = render_ddl(catalog, None, examples).first()["database_schema"]
    assert "Ann" in whole and "Bo" in whole
    schema = "question_id long, database_name string, database_schema string, question string, knowledge string, sql_query string"
    questions = spark.createDataFrame([(1, "db", "old", "q", None, ""), (2, "db", "old", "q", None, "")], schema)
    links = spark.createDataFrame([(1, [("person", ["age"])])], "question_id long, schema_links array<struct<table_name:string,columns:array<string>>>")
    texts = {r["question_id"]: r["database_schema"] for r in apply_links(questions, links, catalog, repair=False, examples=examples).collect()}
    # only the columns that are linked are shown of the rows
    assert "7" in texts[1] and "Ann" not in texts[1] and texts[2] == "old"
    prompts = {r["question_id"]: r["prompt"] for r in schema_prompts(questions.drop("database_schema"), links, catalog, examples=examples).collect()}
    assert "7" in prompts[1] and "Ann" in prompts[2] and whole in prompts[2]


def test_nested_tables_hold_their_names(spark):
    """Links are compared with lists made once per table; names that repeat in a table keep all their columns."""
    rows = [*ROWS, ("db", "pair", 2, "Twin", 0, "text", None, False, False, False), ("db", "pair", 2, "Twin", 1, "real", None, False, True, False), ("db", "pair", 2, "lone", 2, "text", None, False, False, False)]
    nested = nest_catalog(spark.createDataFrame(rows, CATALOG), spark.createDataFrame(KEYS, KEYS_SCHEMA))
    got = nested.selectExpr("inline(tables)").collect()
    assert [(r["key"], r["names"], r["key_names"], r["distinct_names"]) for r in got] == [
        ("person", ["id", "name"], ["id"], True), ("visit", ["person_id", "day"], ["person_id", "day"], True), ("pair", ["Twin", "Twin", "lone"], ["Twin"], False),
    ]
    links = [("pair", ["lone", None, "Twin", "no"]), ("visit", ["day", "no", "day", None])]
    text = nested.crossJoin(spark.createDataFrame([(links,)], f"l {LINKS_TYPE}")).select(ddl_text(F.col("tables"), F.col("l"))).first()[0]
    assert text == "CREATE TABLE `pair`\n(\n`Twin` TEXT  null,\n`Twin` REAL  null  PRIMARY KEY,\n`lone` TEXT  null\n);\n\nCREATE TABLE `visit`\n(\n`day` DATE  null\n);"


def test_links_array():
    rows = [[], [("t", ["a", "b"]), ("u", [])], [("t", ["c"])]]
    want = [[{"table_name": t, "columns": c} for t, c in row] for row in rows]
    assert links_array(rows).to_pylist() == want and links_array([]).to_pylist() == []
