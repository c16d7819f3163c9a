"""Jobs on small fixtures, those without oracle SQL against brute force."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import linking, name_index
from nlsql_spark.operators.execution import row_keys
from nlsql_spark.operators.link_metrics import nested_link_metrics
from nlsql_spark.operators.linking import link_by_substring, link_by_tokens, links_flat
from nlsql_spark.operators.model_steps import embed
from nlsql_spark.plans import jobs as J
from nlsql_spark.session import materialize
from tests.test_linking import Q, links_of


def test_vector_links_equal_brute_force(spark):
    questions = spark.createDataFrame([(i, "db", f"question {i}", "", "k" if i % 2 else None) for i in range(9)], Q)
    documents = spark.createDataFrame([(d, f"t{d % 3}", f"c{d}") for d in range(20)], "document_id long, table_name string, col_name string")
    texts = documents.select(F.col("document_id").alias("example_id"), F.concat_ws(" ", "table_name", "col_name").alias("input_to_embed"))
    got = links_of(J.vector_links(questions, documents, texts, 4, dim=8))
    docs = {r["example_id"]: r["embedding"] for r in embed(texts, dim=8).collect()}
    asked = questions.select(F.col("question_id").alias("example_id"), F.concat_ws(" ", "question", F.coalesce("knowledge", F.lit(""))).alias("input_to_embed"))
    for r in embed(asked, dim=8, is_query=True).collect():
        near = sorted(docs, key=lambda d: (sum((a - b) ** 2 for a, b in zip(docs[d], r["embedding"])), d))[:4]
        want = {}
        for d in sorted(near):
            want.setdefault(f"t{d % 3}", []).append(f"c{d}")
        assert got[r["example_id"]] == list(want.items())


def test_schema_prompts(spark, make_catalog):
    catalog = make_catalog({"person": [("id", True, False), "name"], "pet": ["kind"]})
    questions = spark.createDataFrame([(1, "db", "who?", "", "a fact"), (2, "db", "what?", "", None)], Q)
    links = spark.createDataFrame([(1, [("pet", ["kind"])])], "question_id long, schema_links array<struct<table_name:string,columns:array<string>>>")
    got = {r["question_id"]: r["prompt"] for r in J.schema_prompts(questions, links, catalog).collect()}
    assert got[1].startswith("CREATE TABLE `pet`") and "-- External Knowledge: a fact\n" in got[1] and got[1].endswith("-- who?\n\nSELECT ")
    assert got[2].startswith("CREATE TABLE `person`") and "CREATE TABLE `pet`" in got[2] and "External" not in got[2]


def test_link_report(spark, make_catalog):
    catalog = make_catalog({"person": ["name", "age"], "pet": ["kind"]})
    questions = spark.createDataFrame(
        [(1, "db", "the age", "select age from person", None), (2, "db", "nothing", "select 1", None), (3, "db", "kind", "select name from person", None)], Q)
    row = J.link_report(questions, catalog).first()
    assert (row["false_positive_rate"], row["questions"]) == (0.5, 3)
    assert abs(row["recall"] - 2 / 3) < 1e-12 and row["column_recall"] == 0.5


ODD_IDS = [(1, "db", "the age", "select age from person"), (2, "db", "kind of pet", "select kind from pet, person where age > 1"),
           (2, "zoo", "name and person", "select name from person"), (3, "db", "name", "select kind from pet"), (3, "db", "name", "select kind from pet"),
           (None, "db", "age", "select age from person"), (None, "zoo", "age", "select 1"), (4, "zoo", "nothing", "select age, name from person"),
           (5, "db", None, "select age from person"), (6, "zoo", "person", None)]


@pytest.mark.parametrize("rows", [ODD_IDS, [r for r in ODD_IDS if r[0] in (1, 4, 5, 6)], ODD_IDS[1:3], []])
def test_link_report_equals_joined_lists(spark, make_catalog, rows):
    """Ids that come twice or are NULL, texts that are NULL: the scores are those of the two lists joined on the id."""
    catalog = make_catalog({"person": ["name", "age"], "pet": ["kind"]}).unionByName(make_catalog({"person": ["name", "age"]}, "zoo"))
    questions = spark.createDataFrame([(*r, None) for r in rows], Q)
    want = nested_link_metrics(link_by_tokens(questions, catalog), link_by_substring(questions, catalog)).first()
    assert J.link_report(questions, catalog).first() == want
    assert want["questions"] >= len(rows)


def test_link_report_without_database(spark, make_catalog, monkeypatch):
    """A question without database fails over a small catalogue and has no true links over a large one, as each linker has it."""
    catalog = make_catalog({"person": ["name", "age"]})
    questions = spark.createDataFrame([(1, "db", "age", "select age from person", None), (2, None, "age", "select age from person", None)], Q)
    with pytest.raises(Exception, match="no catalogue for database None"):
        J.link_report(questions, catalog).collect()
    for module in (J, linking, name_index):
        monkeypatch.setattr(module, "is_small", lambda df: False)
    row = J.link_report(questions, catalog).first()
    assert (row["false_positive_rate"], row["recall"], row["column_recall"], row["questions"]) == (0, 1, 1, 2)


def test_link_report_moves_no_links(spark, make_catalog):
    """Token links are many times larger than the questions: over a small catalogue they meet the true links without a shuffle."""
    questions = spark.range(50).selectExpr("id AS question_id", "'db' AS database_name", "'age' AS question", "'select age from person' AS sql_query", "'' AS knowledge")
    report = J.link_report(materialize(questions), make_catalog({"person": ["name", "age"]}))
    assert report.first()["questions"] == 50
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_execution_report(spark):
    spark.range(5).createOrReplaceTempView("five")
    truth = spark.createDataFrame([(1, "simple", "select id from five"), (2, "moderate", "select max(id) from five"), (3, "moderate", "select 1")], "question_id long, difficulty string, sql string")
    preds = spark.createDataFrame([(1, "select 7", 0), (1, "select id from five", 1), (2, "select min(id) from five", 0)], "question_id long, sql string, pos int")
    timings = spark.createDataFrame([(1, 1.0, 1.0)], "question_id long, truth_seconds double, predicted_seconds double")
    accuracy, ves = J.execution_report(spark, truth, preds, timings)
    assert {r["level"]: (r["accuracy"], r["n"]) for r in accuracy.collect()} == {"EASY": (100, 1), "MEDIUM": (0, 2), "OVERALL": (100 / 3, 3)}
    assert abs(ves.first()["ves"] - 100 / 3) < 1e-9


def test_generate_sql(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, prompt string")
    reply = lambda asked: [f"``{p}``\n<|im_end|>" for p in asked]
    assert {r["question_id"]: r["sql"] for r in J.generate_sql(prompts, reply).collect()} == {1: "`a`", 2: "`b`"}


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys_keep_all_rows(spark, make_catalog, hot):
    """One database and one word hold most questions; nothing is dropped."""
    catalog = make_catalog({"person": ["name", "age"], "pet": ["kind"]})
    questions = spark.range(3000).select(
        F.col("id").alias("question_id"), F.lit("db").alias("database_name"),
        F.when(F.col("id") % hot == 0, "the name of it").otherwise("the kind of it").alias("question"),
        F.lit("").alias("sql_query"), F.lit(None).cast("string").alias("knowledge"),
    )
    from nlsql_spark.operators.linking import link_by_tokens

    flat = links_flat(link_by_tokens(questions, catalog))
    assert flat.filter("column_name = 'name'").count() == 3000 // hot
    assert flat.count() == 3000


def test_row_keys_ignore_names_and_keep_column_order(spark):
    keys = lambda sql: {r["row_key"] for r in row_keys(spark.sql(sql)).collect()}
    assert keys("select 1 a, 'x' b") == keys("select 1.0 c, 'x' d") != keys("select 'x' b, 1 a")


def test_embed_keeps_columns_beside_their_vector(spark):
    """The model sees ``batch_size`` texts at once; kept columns need no join on the id, which may repeat."""
    rows = [(i % 7, "x" * (i % 50), i, None if i % 3 else f"l{i}") for i in range(300)]
    texts = spark.createDataFrame(rows, "example_id long, input_to_embed string, place int, label string").coalesce(2)

    def model(asked):
        assert 0 < len(asked) <= 16
        return [None if not t else np.array([len(t), 1], dtype=np.float32) if len(t) % 2 else [len(t), 1] for t in asked]

    got = embed(texts, model, normalize=False, batch_size=16, keep=("place", "label"))
    assert got.columns == ["example_id", "place", "label", "embedding"]
    want = [(i, place, label, [float(len(t)), 1.0] if t else None) for i, t, place, label in rows]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert embed(texts, dim=3, keep=("place",)).columns == ["example_id", "place", "embedding"]


@pytest.mark.parametrize("copies", [1, 2])
def test_probe_report_builds_contexts_once(spark, tmp_path, copies):
    """Every context meets the model once; of a repeated id each vector meets each label, as by a join on the id."""
    samples = spark.createDataFrame(
        [(i, f"p{i}", f"q{i}", [f"a{i}", f"b{i}[BACK]", f"c{i}"]) for i in [*range(40), *range(40)][: 40 * copies]],
        "question_id long, prompt string, question string, reasoning_steps array<string>",
    )
    folder = str(tmp_path)

    def model(asked):
        with open(f"{folder}/{uuid.uuid4()}", "w") as log:
            log.write("x" * len(asked))
        return [[float("b" in t), 1.0] for t in asked]

    row = J.probe_report(samples, model).first()
    n = 40 * 3 * copies * copies
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == n - int(n * 0.8) or copies > 1
    assert sum(len(f.read_text()) for f in tmp_path.iterdir()) == 40 * 3 * copies
    if copies > 1:  # the border of the split is a row of four equal ones
        assert abs(row["tn"] + row["fp"] + row["fn"] + row["tp"] - n * 0.2) <= 4
