import pytest
from pyspark.sql import functions as F

from nlsql_spark.functions import text as X
from nlsql_spark.functions.prompts import fill_prompt, prompt_template, reasoning_request, template_inputs, template_text

L = F.lit


@pytest.mark.parametrize(
    "given, expected",
    [(' \t"My Col`"\n', "my col"), ("Plain", "plain"), (" x　", "x")],
)
def test_normalize_identifier(eval_col, given, expected):
    assert eval_col(X.normalize_identifier(L(given))) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Free_meal-rate, for 2020!", ["free", "meal", "rate", "2020"]),
        ("don't you cannot wanna", ["dont", "wan"]),
        ("haven won the as of", []),
        ("", []),
    ],
)
def test_link_tokens(eval_col, given, expected):
    assert eval_col(X.link_tokens(L(given))) == expected


def test_question_text(eval_col):
    q, k = L("What is the capital of France? "), L(" Paris is the capital of France.")
    assert eval_col(X.question_text(q)) == "what is the capital of france?"
    assert eval_col(X.question_text(q, k)) == "what is the capital of france? paris is the capital of france."


@pytest.mark.parametrize(
    "values, fmt, expected",
    [
        (["Berlin", "Berlin", "Berlin", "Paris", "Rome", "Paris", "Berlin"], "text", "berlin paris rome"),
        ([str(i) for i in range(1, 11)], "integer", "1 10"),
        (["0.01", "100", "1000", "4.05", "100939.76"], "real", "0.01 100939.76"),
        (["2021-01-01", "2021-01-05", "2021-01-02"], "date", "2021-01-01 2021-01-05"),
        (["2018-06-12 09:55:26", "2018-06-12 09:55:22"], "datetime", "2018-06-12 09:55:22 2018-06-12 09:55:26"),
        ([None, "something", "124"], "unknown", ""),
        ([None, None], "text", ""),
    ],
)
def test_document_text_with_values(eval_col, values, fmt, expected):
    column = X.document_text(
        L("countries"), L("Capital "), L("Name of the capital city"), F.col("f"),
        X.representative_values(F.col("v"), F.col("f")),
    )
    out = eval_col(column, "v array<string>, f string", (values, fmt))
    assert out == f"countries capital name of the capital city {fmt} {expected}"


def test_document_text_short_and_excluded(eval_col):
    assert eval_col(X.document_text(L("countries"), L("capital"))) == "countries capital"
    rule = lambda **kw: X.document_text(
        L("countries"), L("capital_ID"), excluded=X.excluded_column(L(True), L("integer"), L("capital_ID"), L("9b2c1f00-1234-4abc-8def-0123456789ab"), **kw)
    )
    for name in ("all_keys", "numeric_keys", "uuid_keys", "id_in_name"):
        assert eval_col(rule(**{name: True})) is None
    assert eval_col(rule()) == "countries capital_id"
    assert eval_col(X.serialize_values(F.array(L("A"), L(None), L("b ")))) == "a none b"


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("a\nb", "SELECT a b"),
        ("a\t\t\t\t\tb", "SELECT a     b"),
        ("``a``", "SELECT `a`"),
        ("a<eos>", "SELECT a"),
        ("a<|im_end|>", "SELECT a"),
        ('x = \\"y\\"', 'SELECT x = "y"'),
    ],
)
def test_clean_sql(eval_col, sql, expected):
    assert eval_col(X.clean_sql(L(sql), add_select=True)) == expected


def test_clean_sql_parts(eval_col):
    assert eval_col(X.clean_sql(L("steps [SQL] bad [SQL]  SELECT 1 "), with_reasoning=True)) == "SELECT 1"
    assert eval_col(X.clean_sql(L("ctx\nhow many? SELECT 2"), question=L("how many?"))) == "SELECT 2"
    assert eval_col(X.clean_sql(L("a q b q c"), question=L("q"))) == "b"
    assert eval_col(X.clean_sql(L("nothing"), question=L("q"))) is None


@pytest.mark.parametrize(
    "response, error, expected",
    [
        ("kept", None, "kept"),
        ("kept", "None", "kept"),
        ("kept", "other", "kept"),
        (None, 'bad { "sql": "SELECT\n 1 " } end', "SELECT  1"),
        (None, '{"sql": ""}', ""),
    ],
)
def test_rescue_sql(eval_col, response, error, expected):
    assert eval_col(X.rescue_sql(F.col("r"), F.col("e")), "r string, e string", (response, error)) == expected


def test_small_columns(eval_col):
    assert eval_col(X.split_steps(L("a\n\n\nb\nc"))) == ["a", "b", "c"]
    assert eval_col(X.split_steps(L(None).cast("string"))) == []
    assert eval_col(X.mask_keys(F.create_map(L("api_key"), L("s"), L("b"), L("t")), ["api_key"])) == {"api_key": "***", "b": "t"}
    assert eval_col(X.map_difficulty(L("moderate"))) == "MEDIUM"
    with pytest.raises(Exception, match="unknown difficulty"):
        eval_col(X.map_difficulty(F.col("d")), "d string", ("odd",))
    assert eval_col(X.mentioned(L("Person"), L("Age"), L("select AGE from person")))
    assert eval_col(X.mentioned(L("t"), L("id"), L("select width from t")))
    assert not eval_col(X.mentioned(L("t"), L("id"), L("select width from t"), word_boundary=True))
    assert eval_col(X.prefix_query(L("q"), True)).endswith("passages: q")
    assert eval_col(X.prefix_query(L("q"), False)) == "q"


def test_any_token_match(eval_col):
    xs, ys = F.array(L("academyx")), F.array(L("academy"), L("zzz"))
    assert not eval_col(X.any_token_match(xs, ys))
    assert eval_col(X.any_token_match(xs, ys, 1))


def test_prompts(spark, eval_col):
    sql = template_text("sql", use_cot=False, has_knowledge=True, with_question=True, open_select=True)
    assert sql == (
        "{database_schema}\n\n-- External Knowledge: {knowledge}\n"
        "-- Using valid SQLite and understanding External Knowledge, answer the following questions for the tables "
        "provided above.\n-- {question}\n\nSELECT "
    )
    link = template_text("schema_linking", use_cot=True, has_knowledge=False, with_question=True, open_select=False)
    assert link.startswith("Database Schema: \n{database_schema}\n\n-- Based on") and link.endswith("step by step: ")
    empty = eval_col(prompt_template("sql", L("")))
    assert "External Knowledge" not in empty and empty.endswith("\n\nSELECT ")
    filled = eval_col(fill_prompt(L("{question}|{database_schema}|{knowledge}"), L("s"), L("k"), L("{knowledge}?")))
    assert filled == "k?|s|k"
    df = spark.createDataFrame([("{question} {knowledge}", "q", "k", "s")], "t string, question string, knowledge string, other string")
    row = template_inputs(df, F.col("t"), ["question", "knowledge", "other"]).first()
    assert row["input_mappings"] == {"question": "q", "knowledge": "k"}
    assert "```\nSELECT 1\n```" in eval_col(reasoning_request(L("SELECT 1")))
