import json

import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import model_steps as M
from nlsql_spark.operators import profile as P
from nlsql_spark.sources import files as S
from nlsql_spark.sources import writers as W
from nlsql_spark.streaming.vector_store import embed_stream, read_store


def _dump(path, obj):
    path.write_text(json.dumps(obj), encoding="utf-8")
    return str(path)


TRAIN = {"db_id": "d", "question": "q", "evidence": "", "SQL": "select 1"}


def test_question_sets(spark, tmp_path):
    train = S.read_questions(spark, _dump(tmp_path / "t.json", [dict(TRAIN, question=f"q{i}") for i in range(5)]), limit=3)
    assert sorted((r["question_id"], r["question"]) for r in train.collect()) == [(0, "q0"), (1, "q1"), (2, "q2")]
    dev = S.read_questions(spark, _dump(tmp_path / "d.json", [dict(TRAIN, question_id=77, difficulty="simple")])).first()
    assert (dev["question_id"], dev["difficulty"], dev["sql_query"]) == (77, "simple", "select 1")
    steps = S.read_questions(spark, _dump(tmp_path / "s.json", [dict(TRAIN, reasoning_steps=["a", "b"])])).first()
    assert steps["reasoning_steps"] == ["a", "b"]
    bad = _dump(tmp_path / "b.json", [TRAIN, dict(TRAIN, extra=1), {"db_id": "d"}])
    with pytest.raises(ValueError, match="unknown fields"):
        S.read_questions(spark, bad)
    good, rejects = S.validate_entries(S.read_json_array(spark, bad))
    assert good.count() == 1 and rejects.count() == 2


def test_catalog_file(spark, tmp_path):
    entry = {
        "db_id": "schools", "table_names_original": ["frpm", "SatScores", "schools"],
        "column_names_original": [[-1, "*"], [0, "CDSCode"], [1, "cds"], [2, "NCESDist"], [2, "NCESSchool"], [1, "cds"]],
        "column_types": ["text", "text", "TEXT", "text", "integer", "text"], "primary_keys": [1, [3]], "foreign_keys": [[1, 3]],
    }
    compound = dict(entry, db_id="other", primary_keys=[[2, 4]], foreign_keys=[])
    rows = S.read_catalog(spark, _dump(tmp_path / "tables.json", [entry, compound])).collect()
    got = {(r["database_name"], r["table_name"], r["column_name"]): (r["is_primary_key"], r["is_foreign_key"]) for r in rows}
    assert len(rows) == 10
    assert got["schools", "frpm", "cdscode"] == (True, True) and got["schools", "schools", "ncesdist"] == (True, True)
    assert got["schools", "satscores", "cds"] == (False, False) and got["schools", "schools", "ncesschool"] == (False, False)
    assert all(got["other", t, c] == (True, False) for t, c in (("satscores", "cds"), ("schools", "ncesschool")))
    # the repeated pair has the flags of its first place
    assert [r["is_primary_key"] for r in rows if r["database_name"] == "other" and r["column_name"] == "cds"] == [True, True]


def test_descriptions(spark, tmp_path):
    text = '﻿original_column_name,column_name,column_description,data_format,value_description\n'
    text += 'CDSCode, Code ,"First\nline, ""x""",integer ,\nCDSCode,,last row,TEXT,\n'
    (tmp_path / "frpm.csv").write_text(text, encoding="utf-8")
    row = S.read_column_descriptions(spark, str(tmp_path), "schools").collect()
    assert len(row) == 1
    assert (row[0]["table_name"], row[0]["original_column_name"], row[0]["column_description"], row[0]["data_format"]) == ("frpm", "cdscode", "last row", "text")


def test_jsonl_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", None), (2, None, "x")], "question_id long, a string, b string")
    W.write_jsonl(df, str(tmp_path / "o"), single_file=True)
    line = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8").splitlines()[0]
    assert line == '{"question_id":1,"a":"ä","b":null}'
    assert S.read_jsonl(spark, str(tmp_path / "o"), "question_id long, a string, b string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"question_id": 1}\n{oops\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "question_id long").collect()


def test_predictions_and_links(spark, tmp_path):
    raw = [
        {"input_data": {"id": "5"}, "response": {"sql": "select 1"}, "error": None},
        {"input_data": {"id": "6"}, "response": None, "error": "E"},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, raw)))
    got = {r["question_id"]: r["sql"] for r in S.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {5: "select 1", 6: ""}
    responses = spark.createDataFrame([("1", "r", None), ("2", None, "E")], "id string, response string, error string")
    assert sorted(r["error"] for r in W.prediction_rows(responses).collect()) == ["E", "None"]
    links = spark.createDataFrame([(1, "q", [("t", ["a", "b"]), ("u", [])])], S.LINKS_SCHEMA)
    W.write_run_results(links, responses, str(tmp_path / "run"))
    assert S.read_links(spark, str(tmp_path / "run/schema_linking")).count() == 1
    assert S.read_links(spark, str(tmp_path / "run/schema_linking"), flat=True).count() == 2
    W.write_run_results(None, responses, str(tmp_path / "run2"))
    assert not (tmp_path / "run2/schema_linking").exists()


def test_registry(spark, tmp_path):
    spark.range(3).withColumn("b", F.lit(1)).write.parquet(str(tmp_path / "t.parquet"))
    registry = S.Registry({"db": str(tmp_path)})
    assert registry.scan(spark, "db", "t", ["b"]).columns == ["b"]
    registry.register_views(spark, "db", ["t"])
    assert spark.sql("select count(*) n from t").first()["n"] == 3
    # tables of equal names in two databases, each in a session of its own
    spark.range(5).write.parquet(str(tmp_path / "other" / "t.parquet"))
    both = S.Registry({"db": str(tmp_path), "more": str(tmp_path / "other")})
    own = {db: both.session(spark, db, ["t"]) for db in ("db", "more")}
    assert [own[db].sql("select count(*) n from t").first()["n"] for db in ("db", "more", "db")] == [3, 5, 3]


def test_profiles_and_documents(spark, make_catalog):
    data = spark.createDataFrame(
        [(i, v, float(i)) for i, v in enumerate(["x", "Y", "x", None, "Y", "z", "w"])], "id long, v string, r double"
    )
    values = P.column_profiles(data, "db", "t", {"id": "integer", "v": "text", "r": "real"}, "id")
    got = {r["column_name"]: r["values_text"] for r in values.collect()}
    assert got == {"id": "0 6", "v": "x y z", "r": "0.0 6.0"}
    assert P.distinct_values(data, ["v"]).count() == 5
    catalog = make_catalog({"t": [("id", True, False), "v", "r"]})
    descriptions = spark.createDataFrame(
        [("db", "t", c, f"About {c}", f) for c, f in (("id", "integer"), ("v", "text"))],
        "database_name string, table_name string, original_column_name string, column_description string, data_format string",
    )
    docs = P.build_documents(catalog, descriptions, values)
    rows = {r["document_id"]: r for r in docs.collect()}
    assert [rows[i]["col_name"] for i in range(3)] == ["id", "v", "r"] and rows[2]["col_description"] is None
    texts = P.document_texts(docs, values_text=F.col("values_text"), all_keys=True)
    # a column without a description stays; only the excluded key goes
    assert sorted(r["input_to_embed"] for r in texts.collect()) == ["t r   0.0 6.0", "t v about v text x y z"]
    numeric = P.document_texts(docs.withColumn("col_data_format", F.lit(None).cast("string")), numeric_keys=True)
    assert numeric.count() == 3
    big = spark.createDataFrame([(1e7, 0.00001), (123456789.5, 2.0)], "a double, b double")
    ends = {r["column_name"]: (r["min_value"], r["max_value"]) for r in P.column_range(big, ["a", "b"]).collect()}
    assert ends == {"a": ("10000000.0", "123456789.5"), "b": ("0.00001", "2.0")}


def _texts(spark, n):
    return spark.range(n).select(F.col("id").alias("example_id"), F.concat(F.lit("t"), "id").alias("input_to_embed"))


def test_generate(spark):
    df = spark.range(10).select("id", F.concat(F.lit("p\n"), "id").alias("prompt"))
    assert {r["id"]: r["response"] for r in M.generate(df).collect()} == {i: str(i) for i in range(10)}

    def picky(prompts):
        if any(p.endswith("3") for p in prompts):
            raise RuntimeError("no threes")
        return [p.upper() for p in prompts]

    rows = {r["id"]: r for r in M.generate(df, picky, max_retries=0, concurrency=2).collect()}
    assert rows[3]["response"] is None and rows[3]["error"] == "RuntimeError: no threes"
    assert all(rows[i]["response"] and rows[i]["error"] is None for i in range(10) if i != 3)


def test_request_batches(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "A").otherwise("B").alias("prompt_template"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("input_mappings"))
    out = M.batch_by_template(df, batch_size=20).collect()
    assert sorted(i for r in out for i in r["ids"]) == list(range(100))
    assert sum(r["prompt_template"] == "A" for r in out) > 3 and all(len(r["ids"]) == len(r["inputs"]) for r in out)


def test_embeddings(spark, tmp_path):
    a = {r["example_id"]: r["embedding"] for r in M.embed(_texts(spark, 5), dim=8).collect()}
    b = {r["example_id"]: r["embedding"] for r in M.embed(_texts(spark, 5).repartition(3), dim=8).collect()}
    assert a == b and abs(sum(x * x for x in a[0]) - 1) < 1e-5
    fn = lambda texts: [[3.0, 4.0] for _ in texts]
    assert [round(x, 6) for x in M.embed(_texts(spark, 1), fn).first()["embedding"]] == [0.6, 0.8]
    store = str(tmp_path / "store")
    assert M.embed_incremental(_texts(spark, 3), store, dim=4).count() == 3
    assert M.embed_incremental(_texts(spark, 5), store, dim=4).count() == 5
    W.write_embeddings(S.read_embeddings(spark, store), str(tmp_path / "copy"))
    assert S.read_embeddings(spark, str(tmp_path / "copy")).count() == 5
    assert len(M.hash_embed(_texts(spark, 1), 6).first()["embedding"]) == 6


def test_stream_embeds_each_id_once(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    run = lambda: embed_stream(spark, source, store, checkpoint, dim=4).awaitTermination(120)
    _texts(spark, 4).write.parquet(source)
    run()
    _texts(spark, 7).write.mode("append").parquet(source)
    run()
    ids = sorted(r["example_id"] for r in read_store(spark, store).collect())
    assert ids == list(range(7))
    # another stream with a checkpoint of its own adds to the store
    more = str(tmp_path / "in2")
    _texts(spark, 9).write.parquet(more)
    embed_stream(spark, more, store, str(tmp_path / "cp2"), dim=4).awaitTermination(120)
    assert sorted(r["example_id"] for r in read_store(spark, store).collect()) == list(range(9))
