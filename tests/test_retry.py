import hashlib
import re

import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import retry as R
from nlsql_spark.operators.probe import label_counts, probe_contexts

STEPS = "question_id long, reasoning_steps array<string>"


def _frame(spark, n=400, steps=("a", "b", "c", "d")):
    return spark.createDataFrame([(i, list(steps)) for i in range(n)], STEPS)


@pytest.mark.parametrize("num", [R.SINGLE, R.MULTIPLE])
@pytest.mark.parametrize("pool", [R.FROM_FUTURE, R.FROM_PAST_AND_FUTURE])
def test_corruption_invariants(spark, num, pool):
    steps = ["a", "b", "c", "d"]
    out = R.corrupt_steps(_frame(spark), 0.3, num, pool, seed=4).collect()
    inserted = 0
    for row in out:
        assert [s for s in row["reasoning_steps"] if not s.endswith("[BACK]")] == steps
        at, run = 0, 0
        for s in row["reasoning_steps"]:
            if s.endswith("[BACK]"):
                run += 1
                inserted += 1
                allowed = steps[at + 1 :] if pool == R.FROM_FUTURE else steps[:at] + steps[at + 1 :]
                assert s.removesuffix("[BACK]") in allowed
                assert num == R.MULTIPLE or run == 1
            else:
                at, run = at + 1, 0
    places = 3 if pool == R.FROM_FUTURE else 4
    expected = 400 * places * (0.3 if num == R.SINGLE else 0.3 / 0.7)
    assert abs(inserted - expected) < 0.2 * expected


def test_draws_do_not_depend_on_partitions(spark):
    df = R.replicate(_frame(spark, 50), 3)
    key = lambda d: sorted((r["question_id"], r["copy"], r["reasoning_steps"]) for r in R.corrupt_steps(d, 0.5).collect())
    one = key(df.coalesce(1))
    assert one == key(df.repartition(7)) and len({str(x[2]) for x in one if x[0] == 1}) > 1


def test_edges(spark):
    assert R.corrupt_steps(_frame(spark, 1, ["only"]), 1.0).first()["reasoning_steps"] == ["only"]
    assert R.corrupt_steps(_frame(spark, 1), 0.0).first()["reasoning_steps"] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        R.corrupt_steps(_frame(spark, 1), 1.0, R.MULTIPLE)


def test_candidates(eval_col):
    steps = F.array(*[F.lit(x) for x in "abc"])
    assert eval_col(R.candidate_steps(steps, F.lit(1))) == ["c"]
    assert eval_col(R.candidate_steps(steps, F.lit(2))) == []
    assert eval_col(R.candidate_steps(steps, F.lit(1), R.FROM_PAST_AND_FUTURE)) == ["a", "c"]


def test_retry_dataset(spark, make_catalog):
    catalog = make_catalog({"person": ["name", "age"], "pet": ["kind"]})
    q = "question_id long, database_name string, question string, sql_query string, knowledge string, reasoning_steps array<string>"
    questions = spark.createDataFrame(
        [(1, "db", "how old?", "select age from person", "", ["x", "y"]), (2, "skip", "q", "s", "", ["x"]),
         (3, "db", "what?", "select kind from pet", "a fact", None)], q)
    out = {(r["question_id"], r["copy"]): r for r in R.build_retry_dataset(questions, catalog, p=0.0, copies=2, skip_databases=("skip",)).collect()}
    assert set(out) == {(1, 1), (1, 2), (3, 1), (3, 2)}
    assert out[1, 1]["prompt"].startswith("CREATE TABLE `person`\n(\n`age` TEXT  null\n);\n\n-- Using valid SQLite, answer")
    assert out[1, 1]["question"] == "how old?" and out[3, 1]["question"] is None
    assert out[3, 1]["prompt"].endswith("-- what?\n") and "-- External Knowledge: a fact\n" in out[3, 1]["prompt"]


def test_attach_steps_joins_on_id(spark):
    entries = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "question_id long, question string")
    replies = spark.createDataFrame([(1, "s1\n\ns2"), (2, None)], "question_id long, reply string")
    got = {r["question_id"]: r["reasoning_steps"] for r in R.attach_steps(entries, replies).collect()}
    assert got == {1: ["s1", "s2"], 2: [], 3: []}


def test_perturb(spark, make_catalog):
    from nlsql_spark.operators.catalog import identifier_pool

    pools = identifier_pool(make_catalog({"person": ["name", "age"], "pet": ["kind"]}))
    df = spark.createDataFrame([(i, "db", "select age, x from person") for i in range(200)], "question_id long, database_name string, sql_query string")
    out = [r["corrupted_query"] for r in R.perturb_identifiers(df, pools, 0.5).collect()]
    assert {o.split(",")[0] for o in out} == {"select age", "select name", "select kind"}
    assert {o.split("from ")[1] for o in out} == {"person", "pet"}
    assert all(", x from" in o for o in out)
    assert all(r["corrupted_query"] == r["sql_query"] for r in R.perturb_identifiers(df, pools, 0.0).collect())
    quoted = df.withColumn("sql_query", F.lit("select 'age it''s age', person.age from person"))
    assert all(r["corrupted_query"].startswith("select 'age it''s age', ") for r in R.perturb_identifiers(quoted, pools, 1.0).collect())
    with pytest.raises(Exception, match="no names for database other"):
        R.perturb_identifiers(df.withColumn("database_name", F.lit("other")), pools, 0.5).collect()


@pytest.mark.parametrize("n, ratio", [(1000, 0.8), (7, 0.5), (3, 0.1), (5, 1.0)])
def test_split_has_exact_size(spark, n, ratio):
    df = spark.range(n)
    out = R.train_val_split(df, "id", ratio, seed=1)
    assert out.filter("is_train").count() == int(n * ratio) and out.count() == n


def _contexts_by_rule(steps):
    items = []
    for s in steps:
        if " [BACK] " in s:
            a, b = s.split(" [BACK] ")[:2]
            items += [(a.strip(), 1), (b.strip(), 0)]
        elif "[BACK]" in s:
            items.append((s.replace("[BACK]", "").strip(), 1))
        else:
            items.append((s.strip(), 0))
    out, current = [], ""
    for i, (text, label) in enumerate(items):
        if label:
            out.append((text if i == 0 else out[-1][0] + " " + text, 1))
        else:
            current = f"{current} {text}" if current else text
            out.append((current, 0))
    return out


def test_probe_contexts(spark):
    import random

    rng = random.Random(2)
    make = lambda: [rng.choice(["a", "b ", "w[BACK]", "x [BACK] y", "", "v[BACK]"]) for _ in range(rng.randint(0, 9))]
    lists = [make() for _ in range(300)]
    df = spark.createDataFrame([(i, "P", "Q", s) for i, s in enumerate(lists)], "question_id long, prompt string, question string, reasoning_steps array<string>")
    got = {}
    for r in probe_contexts(df).orderBy("question_id", "item").collect():
        got.setdefault(r["question_id"], []).append((r["text"], r["label"]))
    for i, steps in enumerate(lists):
        assert got.get(i, []) == [(f"[CONTEXT] P[QUESTION] Q\n[REASONING] {t}", y) for t, y in _contexts_by_rule(steps)]
    counts = label_counts(probe_contexts(df)).first()
    assert counts["wrong"] + counts["correct"] == sum(len(v) for v in got.values())


def test_perturb_picks_as_from_a_filtered_pool(spark):
    """Repeated, odd and single names: the pick is that of the pool without the name, a lone name stays."""
    pools = spark.createDataFrame(
        [("once", ["t", "u"], ["a", "b", "É", "'x y'", None]), ("twice", ["t", "t", "u"], ["a", "b", "b", "c"]), ("lone", ["t"], ["a", "t"]), ("none", [], None)],
        "database_name string, tables array<string>, columns array<string>",
    )
    q = spark.range(200).crossJoin(pools.select("database_name")).selectExpr("id as question_id", "database_name", "\"SELECT a, b, É FROM t u WHERE a = 'x y' or c\" as sql_query")
    got = R.perturb_identifiers(q, pools, 0.6, seed=4).drop("sql_query")
    known = {r["database_name"]: (r["tables"], r["columns"]) for r in pools.collect()}
    pieces = re.findall(r"'(?:[^']|'')*'|[A-Za-z0-9_]+|[^A-Za-z0-9_']+", "SELECT a, b, É FROM t u WHERE a = 'x y' or c")
    draw = lambda *keys: (int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    for r in got.collect():
        tables, columns = known[r["database_name"]]
        out = []
        for i, piece in enumerate(pieces):
            names = tables if piece in tables else columns if columns and piece in columns else None
            pool = [n for n in names or () if n is not None and n != piece]
            swap = pool and draw(4, r["question_id"], i) < 0.6
            out.append(pool[int(draw(4, r["question_id"], i, "pick") * len(pool))] if swap else piece)
        assert r["corrupted_query"] == "".join(out)
