import math
import random

import pytest
from pyspark.sql import functions as F

from nlsql_spark.functions.rewards import ves_reward
from nlsql_spark.operators import execution as E
from nlsql_spark.operators import link_metrics as M
from nlsql_spark.operators import scoring as S
from nlsql_spark.operators.confidence import confidence_per_sequence, marker_confidence, step_confidence
from nlsql_spark.operators.linking import LINKS_TYPE
from nlsql_spark.operators.probe import binary_report, score_probe, train_probe

LINK = "question_id long, table_name string, column_name string"
T1, T2 = (1, "cards", "rarity"), (2, "players", "name")


@pytest.mark.parametrize(
    "truth, pred, expected",
    [
        ([T1, T2], [T1, T2], (0, 1, 1)),
        ([T1, T2], [(1, "cards", "x"), (2, "game", "y")], (1, 0, 0)),
        ([T1, T2], [T1, (2, "game", "y")], (0.5, 0.5, 0.5)),
        ([T1, T2], [T1, (1, "cards", "x"), T2, (2, "game", "y")], (0.5, 1, 1)),
        ([T1, (1, "game", "name"), T2], [T1, (1, "game", "name"), T2, (2, "players", "x")], (0.25, 1, 1)),
        ([T1, T2, T2], [], (0, 0, 0)),
    ],
)
def test_link_metrics(spark, truth, pred, expected):
    t, p = spark.createDataFrame(truth, LINK), spark.createDataFrame(pred, LINK)
    row = M.link_metrics(p, t).first()
    assert (row["false_positive_rate"], row["recall"], row["column_recall"]) == expected
    assert M.link_fpr(p, t).first()[0] == expected[0]
    nest = lambda df: df.groupBy("question_id", "table_name").agg(F.collect_list("column_name").alias("columns")).groupBy("question_id").agg(F.collect_list(F.struct("table_name", "columns")).alias("schema_links"))
    assert M.nested_link_metrics(nest(p), nest(t)).first() == row
    assert M.link_recall(p, t).first()[0] == expected[1]
    assert M.column_recall(p, t).first()["column_recall"] == expected[2]


def half_of(df, k):
    return df.filter(F.col("question_id") % 2 == k)


def test_nested_counts_of_odd_lists(spark):
    """Tables that come twice, names that come twice, are NULL or hold the joining sign: counted as texts of the pairs; also beside each other."""
    rng = random.Random(3)
    pick = lambda odd: rng.choice(["a", "b", "ab", "", *([None, "a\x00b", "\x00"] if odd else [])])
    some = lambda odd: [(pick(odd), [pick(odd) for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 4))]
    rows = [(i, *(None if rng.random() < 0.1 else some(i % 2) for _ in range(2))) for i in range(300)]
    both = spark.createDataFrame(rows, "question_id long, schema_links " + LINKS_TYPE + ", t " + LINKS_TYPE)
    texts = lambda links: {"\x00".join(x for x in (table, c) if x is not None) for table, columns in links or [] for c in columns}
    want = {i: (len(texts(p)), len(texts(t)), len(texts(p) & texts(t))) for i, p, t in rows}
    beside = M.nested_link_counts(both, "t")
    joined = M.nested_link_counts(both, both.select("question_id", F.col("t").alias("schema_links")))
    for counts in (beside, joined):
        assert {r[0]: tuple(r)[1:] for r in counts.select("question_id", "n_pred", "n_truth", "n_both").collect()} == want
    assert M.nested_link_metrics(half_of(both, 0), "t", (half_of(both, 1), "t")).first() == M.nested_link_metrics(both, "t").first()


def test_same_ids(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "question_id long")
    assert M.assert_same_ids(ids(1, 2), ids(2, 1)).count() == 2
    for a, b in (((1, 2), (1,)), ((1, 2), (1, 3)), ((1, 1), (1,))):
        with pytest.raises(Exception, match="differ on id"):
            M.assert_same_ids(ids(*a), ids(*b)).collect()


@pytest.fixture(scope="module")
def databases(spark):
    spark.createDataFrame([("John Smith", "Plumber"), ("Mary Potter", "Nurse"), ("Anna Wilson", "Nurse")], "name string, profession string").createOrReplaceTempView("person")
    spark.createDataFrame([("Cat", 10), ("Dog", 15), ("Hamster", 2)], "name string, size int").createOrReplaceTempView("animal")


def test_execution_match(spark, databases):
    pairs = [
        (1, "select name from person", "select name from person order by name desc"),
        (2, "select name from animal where size > 5", "select name from animal where size > 12"),
        (3, "select size from animal", "select size * 1.0 from animal"),
        (4, "select name, size from animal", "select size, name from animal"),
        (5, "select name from person where name = 'zz'", "select nope from person"),
        (6, "select profession from person", "select distinct profession from person"),
        (7, "select name from person", "drop view person"),
        (8, "select null from animal", "select null from person"),
        (9, "select nope from person", ""),
    ]
    df = spark.createDataFrame(pairs, "question_id long, truth_sql string, predicted_sql string")
    got = {r["question_id"]: r["matched"] for r in E.execution_match(spark, df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False, 8: True, 9: True}
    strict = {r["question_id"]: r for r in E.execution_match(spark, pairs, strict_errors=True).collect()}
    assert not strict[5]["matched"] and "nope" in strict[5]["error"] and strict[1]["error"] is None
    assert not strict[9]["matched"]


def test_changes_are_refused(spark, databases, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS changed (a INT) USING parquet LOCATION '{tmp_path}/changed'")
    for text in (
        "WITH t AS (SELECT 9 AS a) INSERT INTO changed SELECT a FROM t",
        "WITH t AS (SELECT 9 AS a) DELETE FROM changed",
        "WITH t AS (SELECT 9 AS a) UPDATE changed SET a = 1",
        "SELECT 1) ; DROP TABLE changed; SELECT (1",
    ):
        assert not E.is_executable(spark, text)
        assert not E.execution_match(spark, [(1, "select name from person", text)]).first()["matched"]
    assert spark.table("changed").count() == 0
    spark.sql("DROP TABLE changed")
    for text in ("WITH t AS (SELECT 1 AS a) SELECT a, a FROM t;", "select name from person -- all\n"):
        assert E.is_executable(spark, text)


def test_two_databases_with_equal_table_names(spark):
    def bind(session, name):
        size = {"small": 2, "large": 5}[name]
        session.sql(f"CREATE OR REPLACE TEMP VIEW thing AS SELECT id FROM range({size})")

    pairs = [(1, "select id from thing", "select id from range(2)", "small"), (2, "select id from thing", "select id from range(2)", "large"), (3, "select is_cancelled from thing", "select nosuch from thing", "large")]
    got = {r["question_id"]: (r["matched"], r["error"] == "timeout") for r in E.execution_match(spark, pairs, bind=bind).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False)}


def test_decimals_are_compared_exactly(spark):
    one = lambda text: spark.sql(f"SELECT {text} AS a")
    same = lambda a, b: E.results_match(one(a), one(b)).first()["matched"]
    assert not same("CAST('0.12345678901234567891' AS DECIMAL(38,20))", "CAST('0.12345678901234567892' AS DECIMAL(38,20))")
    assert same("CAST(1.50 AS DECIMAL(10,2))", "1.5D") and same("CAST(9e15 AS DOUBLE)", "9000000000000000L") and not same("1.5D", "'1.5'")


def test_timeout_is_a_mismatch(spark, databases):
    slow = "select count(*) from range(3000000000) a where (id * id) % 7 = (id + 3) % 5"
    row = E.execution_match(spark, [(1, slow, slow)], timeout_s=0.3, parallel=1).first()
    assert not row["matched"] and row["error"] == "timeout"


def test_results_match(spark):
    df = lambda rows: spark.createDataFrame(rows, "a int, b string")
    assert E.results_match(df([(1, None), (1, None)]), df([(1, None)])).first()["matched"]
    assert not E.results_match(df([(1, "x")]), df([(1, "x"), (2, "x")])).first()["matched"]
    assert not E.results_match(spark.sql("select 1"), spark.sql("select '1'")).first()["matched"]
    assert E.results_match(spark.sql("select true, 2.50"), spark.sql("select 1, 2.5D")).first()["matched"]


def test_executable(spark, databases):
    ok = {"select 1": True, "  ": False, "select nope from person": False, "selec 1": False, "drop view person": False, "with a as (select 1 x) select x from a": True}
    df = spark.createDataFrame(list(enumerate(ok)), "question_id long, q string")
    got = {r["question_id"]: r["executable"] for r in E.executable_flags(spark, df, "q").collect()}
    assert list(got[i] for i in range(len(ok))) == list(ok.values())


def _scores(spark, levels, hits):
    truth = spark.createDataFrame(list(enumerate(levels)), "question_id long, difficulty string")
    matches = spark.createDataFrame([(i, h) for i, h in enumerate(hits) if h is not None], "question_id long, matched boolean")
    return {r["level"]: r["accuracy"] for r in S.execution_accuracy(matches, truth).collect()}


def test_execution_accuracy(spark):
    assert _scores(spark, ["EASY", "MEDIUM", "HARD"], [True] * 3) == {"EASY": 100, "MEDIUM": 100, "HARD": 100, "OVERALL": 100}
    assert _scores(spark, ["EASY", "MEDIUM", "MEDIUM", "HARD"], [True, False, None, True]) == {"EASY": 100, "MEDIUM": 0, "HARD": 100, "OVERALL": 50}


def test_pairing(spark):
    truth = spark.createDataFrame([(1,), (2,)], "question_id long")
    preds = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "question_id long, sql string, pos int")
    got = {r["question_id"]: (r["predicted_sql"], r["missing"]) for r in S.pair_results(truth, preds).collect()}
    assert got == {1: ("b", False), 2: (None, True)}
    assert S.count_by_difficulty(truth.withColumn("difficulty", F.lit("EASY"))).first()["n"] == 2


@pytest.mark.parametrize("ratio, reward", [(0, 0), (0.1, 0.25), (0.25, 0.5), (0.5, 0.75), (1, 1), (1.99, 1), (2, 1.25)])
def test_reward(eval_col, ratio, reward):
    assert eval_col(ves_reward(F.lit(float(ratio)))) == reward


def test_ves(spark):
    runs = [(1, 2.0, 1.0)] * 5 + [(2, 1.0, 1.0)] * 30 + [(2, 900.0, 1.0)] + [(3, 1.0, 1.0)]
    timings = spark.createDataFrame(runs, "question_id long, truth_seconds double, predicted_seconds double")
    matches = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "question_id long, matched boolean")
    got = {r["question_id"]: (r["time_ratio"], r["score"]) for r in S.question_efficiency(timings, matches).collect()}
    assert got == {1: (2.0, math.sqrt(1.25)), 2: (1.0, 1.0), 3: (1.0, 0.0), 4: (None, 0.0)}
    assert abs(S.valid_efficiency_score(timings, matches).first()["ves"] - 100 * (math.sqrt(1.25) + 1) / 4) < 1e-9


def test_log_summary(spark):
    row = S.training_log_summary(spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0)], "step int, device int, loss double")).first()
    assert row["avg_loss"] == 2 and abs(row["perplexity"] - math.exp(2)) < 1e-12


def _windows_by_rule(tokens, scores, radius=10):
    pairs = scores[1 : len(tokens) + 1]
    mean = lambda xs: 100 * sum(xs) / len(xs) if xs else None
    return {
        i: (mean(pairs[max(0, i - radius) : i]), mean(pairs[i + 1 : i + radius]))
        for i, t in enumerate(tokens) if t == "[BACK]"
    }


@pytest.mark.parametrize("block", [1_000_000, 16])
def test_marker_windows(spark, block):
    tokens = ["[BACK]" if i in (0, 3, 17, 40, 58, 59) else "t" for i in range(60)]
    scores = [((i * 37) % 101) / 101 for i in range(60)]
    df = spark.createDataFrame([(1, i, t, s, s / 2) for i, (t, s) in enumerate(zip(tokens, scores))], "question_id long, position long, token string, mean double, std double")
    out = marker_confidence(df, F.col("token") == "[BACK]", block=block)
    want = _windows_by_rule(tokens, scores)
    got = {r["position"]: r for r in out.collect()}
    assert set(got) == set(want)
    for i, (before, after) in want.items():
        for value, expected in ((got[i]["mean_before"], before), (got[i]["mean_after"], after)):
            assert (value is None) == (expected is None) and (value is None or abs(value - expected) < 1e-9)
    assert len(confidence_per_sequence(out).first()["scores"]) == 6


def test_step_confidence(spark):
    rows = [(1, 0, b, p) for b, ps in enumerate([(0.1, 0.9), (0.5, 0.3)]) for p in ps] + [(1, 1, 0, 0.4)]
    got = {r["step"]: r for r in step_confidence(spark.createDataFrame(rows, "question_id long, step int, beam int, prob double")).collect()}
    assert abs(got[0]["mean"] - 0.7) < 1e-12 and abs(got[0]["std"] - math.sqrt(0.08)) < 1e-12 and got[1]["std"] is None


def test_probe_model_and_report(spark):
    rows = [([float(i % 2) * 2 - 1 + (i % 5) * 0.01, 0.3], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "embedding array<float>, label int")
    scored = score_probe(train_probe(df), df)
    row = binary_report(scored).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (30, 30, 0, 0) and row["f1"] == 1 and row["balanced_accuracy"] == 1
    hand = spark.createDataFrame([(1, 1, 0.8), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.7)], "label int, prediction int, probability double")
    row = binary_report(hand).first()
    assert row["f1"] == 0.5 and row["balanced_accuracy"] == 0.5
    assert abs(row["loss"] + sum(map(math.log, (0.8, 0.4, 0.9, 0.3))) / 4) < 1e-12


def test_fingerprints(spark):
    from nlsql_spark.operators.execution import fingerprint

    rows = [(1, "a"), (2, "b"), (1, "a"), (None, "c"), (3, None)]
    df = lambda r, cols="x int, y string": spark.createDataFrame(r, cols)
    one = fingerprint(df(rows)).first()
    assert one["rows"] == 4 and one == fingerprint(df(rows[::-1] * 3).repartition(3)).first()
    assert one == fingerprint(df([(float(x) if x else None, y) for x, y in rows], "p double, q string")).first()
    others = [rows[:4], [*rows, (4, "d")], [(2, "a"), (1, "b"), (None, "c"), (3, None)], [(y, x) for x, y in rows]]
    prints = {fingerprint(df(r, "x string, y int" if i == 3 else "x int, y string")).first() for i, r in enumerate(others)}
    assert len(prints) == 4 and one not in prints
    assert tuple(fingerprint(df([])).first()) == (0, 0, 0)
