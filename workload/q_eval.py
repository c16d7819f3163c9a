"""Evaluation queries: execution match, accuracy, efficiency, confidence, classifier report."""

from pyspark.sql import functions as F

from nlsql_spark.operators import execution as E
from nlsql_spark.operators import scoring as S
from nlsql_spark.operators.confidence import marker_confidence, step_confidence
from nlsql_spark.operators.ordering import ordered_position
from nlsql_spark.operators.probe import binary_report, score_probe, train_probe
from nlsql_spark.plans.jobs import execution_report, marker_report, probe_report
from workload.inputs import QUESTIONS_SQL, questions, table
from workload.q_retry import PROBE_SRC, probe_samples
from workload.registry import query

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]

# (id, difficulty, truth, prediction): the benchmark questions, run over the whole given tables
BENCHMARK = [
    (1, "simple", "SELECT c_name FROM customer WHERE c_acctbal > 5000", "SELECT c_name FROM customer WHERE c_acctbal > 5000 ORDER BY c_name"),
    (2, "simple", "SELECT n_name FROM nation", "SELECT DISTINCT n_name FROM nation WHERE n_regionkey >= 0"),
    (3, "simple", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'"),
    (4, "simple", "SELECT max(p_size) FROM part", "SELECT max(p_size) * 1.0 FROM part"),
    (5, "moderate", "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT count(*), o_orderstatus FROM orders GROUP BY o_orderstatus"),
    (6, "moderate", "SELECT p_brand, count(*) FROM part GROUP BY p_brand", "SELECT p_brand, sum(1) FROM part GROUP BY p_brand"),
    (7, "moderate", "SELECT s.s_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 1",
     "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    (8, "moderate", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT c_nam FROM customer"),
    (9, "moderate", "SELECT event_type, max(value) FROM events GROUP BY event_type", "SELECT event_type, value FROM events e WHERE value = (SELECT max(value) FROM events f WHERE f.event_type = e.event_type)"),
    (10, "challenging", "SELECT l_returnflag, l_linestatus, count(*), min(l_quantity) FROM lineitem GROUP BY l_returnflag, l_linestatus",
     "SELECT l_returnflag, l_linestatus, count(l_orderkey), min(l_quantity) FROM lineitem GROUP BY 1, 2"),
    (11, "challenging", "SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
     "SELECT p_name FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE l.l_quantity >= 50"),
    (12, "challenging", "SELECT o_orderkey, count(l_linenumber) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
     "SELECT o_orderkey, count(l_linenumber) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    (13, "challenging", "SELECT d.source, avg(l.quality) > 0.5 FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source",
     "SELECT source, sum(quality) > 0.5 * count(*) FROM documents JOIN labels USING (doc_id) GROUP BY source"),
    (14, "simple", "SELECT lang FROM documents WHERE n_chars < 0", "DELETE FROM documents"),
]


def same_sql(truth: str, predicted: str | None) -> str:
    """Whether two results are equal as sets of rows."""
    if predicted is None:
        return f"(SELECT count(*) = 0 FROM ({truth}))"
    return f"(NOT EXISTS (({truth}) EXCEPT ({predicted})) AND NOT EXISTS (({predicted}) EXCEPT ({truth})))"


# 8 does not resolve and 14 is no query: both count as empty results
RUNS = {8: None, 14: None}
MATCH_SQL = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS question_id, '{d}' AS difficulty, {same_sql(t, RUNS.get(i, p))} AS matched" for i, d, t, p in BENCHMARK
)


def _views(spark, sf):
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)


def _benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "question_id long, difficulty string, truth_sql string, predicted_sql string")


@query("set_04_execution_match", f"SELECT question_id, matched FROM ({MATCH_SQL})")
def _(spark, sf):
    _views(spark, sf)
    return E.execution_match(spark, _benchmark(spark), timeout_s=600).select("question_id", "matched")


def _bind(sf):
    """Two databases with a table of the same name: ``thing`` holds parts in one and orders in the other."""

    def bind(session, name):
        source, key = {"parts": ("part", "p_partkey"), "orders": ("orders", "o_orderkey")}[name]
        session.read.parquet(f"{sf}/{source}.parquet").select(F.col(key).alias("id")).createOrReplaceTempView("thing")

    return bind


@query("set_04_two_databases", """
SELECT 1::BIGINT AS question_id, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) = (SELECT count(*) FROM part WHERE p_partkey % 2 <> 1) AS matched
UNION ALL SELECT 2, (SELECT count(*) FROM orders) = (SELECT count(*) FROM part)
UNION ALL SELECT 3, (SELECT max(o_orderkey) FROM orders) = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey > 10)
UNION ALL SELECT 4, false""")
def _(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    pairs = [
        (1, "SELECT count(*) FROM thing WHERE id % 2 = 0", "SELECT count(*) FROM thing WHERE id % 2 <> 1", "parts"),
        (2, "SELECT count(*) FROM thing", f"SELECT CAST({parts} AS BIGINT)", "orders"),
        (3, "SELECT max(id) FROM thing", "SELECT max(id) FROM thing WHERE id > 10", "orders"),
        (4, "SELECT id FROM thing", "WITH t AS (SELECT 1 AS a) INSERT INTO thing SELECT a FROM t", "parts"),
    ]
    return E.execution_match(spark, pairs, timeout_s=600, bind=_bind(sf)).select("question_id", "matched")


@query("set_04_results_match", """
SELECT NOT EXISTS ((SELECT l_orderkey, l_partkey FROM lineitem) EXCEPT (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 50))
    AND NOT EXISTS ((SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 50) EXCEPT (SELECT l_orderkey, l_partkey FROM lineitem)) AS matched""")
def _(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return E.results_match(line.drop("l_quantity"), line.filter("l_quantity < 50").drop("l_quantity"))


LEVELS_SQL = "CASE difficulty WHEN 'simple' THEN 'EASY' WHEN 'moderate' THEN 'MEDIUM' WHEN 'challenging' THEN 'HARD' END"


@query("job_10_execution_report", f"""
WITH m AS (SELECT question_id, {LEVELS_SQL} AS level, matched FROM ({MATCH_SQL}))
SELECT coalesce(level, 'OVERALL') AS level, round(100.0::DOUBLE * sum(matched::INTEGER)::DOUBLE / count(*), 6) AS accuracy, count(*) AS n FROM m GROUP BY ROLLUP (level)""")
def _(spark, sf):
    _views(spark, sf)
    b = _benchmark(spark)
    truth = b.select("question_id", "difficulty", F.col("truth_sql").alias("sql"))
    old = b.select("question_id", F.lit("SELECT 1").alias("sql"), F.lit(0).alias("pos"))
    last = b.select("question_id", F.col("predicted_sql").alias("sql"), F.lit(1).alias("pos"))
    accuracy, _ = execution_report(spark, truth, old.unionByName(last), timeout_s=600)
    return accuracy.withColumn("accuracy", F.round("accuracy", 6))


@query("flt_04_is_executable", """
SELECT min(p_partkey) AS question_id, true AS executable FROM part GROUP BY p_brand
UNION ALL SELECT -1 - min(p_partkey), false FROM part GROUP BY p_type""")
def _(spark, sf):
    """A query per brand that resolves, and one per type that asks for a column of that name."""
    _views(spark, sf)
    part = table(spark, sf, "part")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    good = part.groupBy("p_brand").agg(F.min("p_partkey").alias("question_id")).select(
        "question_id", text("SELECT count(*) FROM part WHERE p_brand = '", F.col("p_brand"), "'").alias("q")
    )
    bad = part.groupBy("p_type").agg((-1 - F.min("p_partkey")).alias("question_id")).select(
        "question_id", text("SELECT ", F.col("p_type"), " FROM part").alias("q")
    )
    return E.executable_flags(spark, good.unionByName(bad), "q")


# predictions per order: two versions, the later one wins; orders of large first line have none
PRED_SQL = """
preds AS (SELECT question_id, sql_query AS sql, 0 AS pos FROM questions WHERE first_line < 3
    UNION ALL SELECT question_id, upper(sql_query), 1 FROM questions WHERE first_line = 2),
last AS (SELECT question_id, arg_max(sql, pos) AS predicted_sql FROM preds GROUP BY 1),
paired AS (SELECT q.question_id, q.difficulty, q.sql_query, predicted_sql, predicted_sql IS NULL AS missing FROM questions q LEFT JOIN last USING (question_id))"""


def _pairs(spark, sf):
    q = questions(spark, sf)
    first = q.filter("first_line < 3").select("question_id", F.col("sql_query").alias("sql"), F.lit(0).alias("pos"))
    later = q.filter("first_line = 2").select("question_id", F.upper("sql_query").alias("sql"), F.lit(1).alias("pos"))
    return S.pair_results(q.select("question_id", "difficulty", "sql_query"), first.unionByName(later))


@query("join_06_pair_results", f"WITH {QUESTIONS_SQL}, {PRED_SQL} SELECT question_id, predicted_sql, missing FROM paired")
def _(spark, sf):
    return _pairs(spark, sf).select("question_id", "predicted_sql", "missing")


@query("agg_05_count_by_difficulty", f"WITH {QUESTIONS_SQL} SELECT difficulty, count(*) AS n FROM questions GROUP BY 1")
def _(spark, sf):
    return S.count_by_difficulty(questions(spark, sf))


@query("agg_06_execution_accuracy", f"""
WITH {QUESTIONS_SQL}, {PRED_SQL}, m AS (SELECT difficulty, coalesce(predicted_sql = sql_query, false) AS hit FROM paired)
SELECT coalesce(difficulty, 'OVERALL') AS level, round(100.0::DOUBLE * sum(hit::INTEGER)::DOUBLE / count(*), 6) AS accuracy, count(*) AS n FROM m GROUP BY ROLLUP (difficulty)""")
def _(spark, sf):
    paired = _pairs(spark, sf)
    matches = paired.filter("not missing").select("question_id", (F.col("predicted_sql") == F.col("sql_query")).alias("matched"))
    return S.execution_accuracy(matches, paired.select("question_id", "difficulty")).withColumn("accuracy", F.round("accuracy", 6))


# runs of a part: each line item is one timed run
RUNS_SQL = """
runs AS (SELECT l_partkey AS question_id, l_extendedprice AS truth_seconds, l_quantity * 1000 AS predicted_seconds FROM lineitem),
ratios AS (SELECT question_id, truth_seconds / predicted_seconds AS ratio FROM runs),
st AS (SELECT question_id, avg(ratio) AS m, stddev_pop(ratio) AS sd, min(ratio) AS lo, max(ratio) AS hi FROM ratios GROUP BY 1),
kept AS (SELECT r.* FROM ratios r JOIN st USING (question_id) WHERE abs(ratio - m) < 2 * sd OR lo = hi)"""


def _runs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("question_id"), F.col("l_extendedprice").alias("truth_seconds"),
        (F.col("l_quantity") * 1000).alias("predicted_seconds"),
    )


@query("agg_12_drop_outliers", f"WITH {RUNS_SQL} SELECT question_id, ratio FROM kept")
def _(spark, sf):
    ratios = _runs(spark, sf).select("question_id", (F.col("truth_seconds") / F.col("predicted_seconds")).alias("ratio"))
    return S.drop_outliers(ratios, "question_id", "ratio", k=2)


VES_SQL = """
tr AS (SELECT question_id, avg(ratio) AS r FROM kept GROUP BY 1),
sc AS (SELECT p_partkey AS question_id, p_size % 2 = 1 AS matched, r, CASE WHEN p_size % 2 = 1 AND r IS NOT NULL THEN sqrt(CASE WHEN r = 0 THEN 0 WHEN r >= 2 THEN 1.25 WHEN r >= 1 THEN 1
    WHEN r >= 0.5 THEN 0.75 WHEN r >= 0.25 THEN 0.5 ELSE 0.25 END::DOUBLE) ELSE 0 END AS score FROM part LEFT JOIN tr ON tr.question_id = p_partkey)"""


@query("agg_11_valid_efficiency_score", f"""
WITH {RUNS_SQL.replace('2 * sd', '3 * sd')}, {VES_SQL} SELECT round(100 * sum(score) / count(*), 5) AS ves, count(*) AS n FROM sc""")
def _(spark, sf):
    matches = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_size") % 2 == 1).alias("matched"))
    return S.valid_efficiency_score(_runs(spark, sf), matches).withColumn("ves", F.round("ves", 5))


@query("agg_15_training_log_summary", """
WITH s AS (SELECT floor(event_id / 50)::BIGINT AS step, avg(value / 100) AS l FROM events GROUP BY 1)
SELECT step, round(l, 6) AS avg_loss, round(exp(l), 5) AS perplexity FROM s""")
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 50).alias("step"), F.col("user_id").alias("device"), (F.col("value") / 100).alias("loss")
    )
    out = S.training_log_summary(log)
    return out.select("step", F.round("avg_loss", 6).alias("avg_loss"), F.round("perplexity", 5).alias("perplexity"))


@query("agg_18_step_confidence", """
WITH t AS (SELECT user_id AS question_id, event_id % 7 AS step, event_type AS beam, max(value / 500) AS p FROM events GROUP BY 1, 2, 3)
SELECT question_id, step, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std FROM t GROUP BY 1, 2""")
def _(spark, sf):
    probs = table(spark, sf, "events").select(
        F.col("user_id").alias("question_id"), (F.col("event_id") % 7).alias("step"), F.col("event_type").alias("beam"),
        (F.col("value") / 500).alias("prob"),
    )
    return step_confidence(probs).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# tokens = a user's events in time order, marker = error, confidence = value
MARK_SQL = """
e AS (SELECT user_id AS question_id, row_number() OVER w - 1 AS position, event_type, lead(value / 500) OVER w AS m, lead(value / 1000) OVER w AS s
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT question_id, position, event_type, avg(m) OVER b AS mb, avg(s) OVER b AS sb, avg(m) OVER a AS ma, avg(s) OVER a AS sa FROM e
    WINDOW b AS (PARTITION BY question_id ORDER BY position ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY question_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING)),
marks AS (SELECT question_id, position, round(100 * mb, 8) AS mean_before, round(100 * sb, 8) AS std_before, round(100 * ma, 8) AS mean_after,
    round(100 * sa, 8) AS std_after FROM k WHERE event_type = 'error')"""


def _tokens(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("question_id"), "ts", "event_id", "event_type", (F.col("value") / 500).alias("mean"),
        (F.col("value") / 1000).alias("std"),
    )
    return ordered_position(e, ["ts", "event_id"], ["question_id"])


@query("win_03_marker_confidence", f"WITH {MARK_SQL} SELECT * FROM marks")
def _(spark, sf):
    m = marker_confidence(_tokens(spark, sf), F.col("event_type") == "error")
    return m.withColumns({c: F.round(c, 8) for c in ("mean_before", "std_before", "mean_after", "std_after")})


@query("job_12_marker_report", f"WITH {MARK_SQL} SELECT question_id, count(*)::INTEGER AS markers, round(avg(mean_before), 4) AS mean_before FROM marks GROUP BY 1")
def _(spark, sf):
    r = marker_report(_tokens(spark, sf), F.col("event_type") == "error")
    each = r.select("question_id", F.size("scores").alias("markers"), F.explode("scores").alias("s"))
    return each.groupBy("question_id", "markers").agg(F.round(F.avg(F.round("s.before.mean", 8)), 4).alias("mean_before"))


@query("agg_14_binary_report", """
WITH d AS (SELECT quality AS y, toxic AS p, (doc_id % 97 + 1) / 99.0::DOUBLE AS q FROM labels),
c AS (SELECT count(CASE WHEN y = 0 AND p = 0 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND p = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND p = 0 THEN 1 END) AS fn,
    count(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS tp, avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS loss FROM d)
SELECT round(loss, 6) AS loss, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 6) AS balanced_accuracy, tn, fp, fn, tp FROM c""")
def _(spark, sf):
    d = table(spark, sf, "labels").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction"), ((F.col("doc_id") % 97 + 1) / 99.0).alias("probability")
    )
    return binary_report(d).withColumns({c: F.round(c, 6) for c in ("loss", "f1", "balanced_accuracy")})


@query("ml_01_linear_probe", """
SELECT sum(t)::BIGINT AS wrong, sum(1 - t)::BIGINT AS correct, true AS far_above_chance
FROM (SELECT (embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0)::INTEGER AS t FROM embeddings WHERE vec_id % 5 = 0)""")
def _(spark, sf):
    """A probe for the side of a plane that a vector lies on, trained on four fifths and scored on the rest."""
    x = lambda i: F.col("embedding")[i].cast("double")
    v = table(spark, sf, "embeddings").withColumn("target", (x(0) + x(1) > 0).cast("int"))
    model = train_probe(v.filter("vec_id % 5 <> 0"), "embedding", "target", maxIter=20)
    report = binary_report(score_probe(model, v.filter("vec_id % 5 = 0")), "target")
    return report.select((F.col("tp") + F.col("fn")).alias("wrong"), (F.col("tn") + F.col("fp")).alias("correct"), (F.col("balanced_accuracy") > 0.85).alias("far_above_chance"))


def marker_features(texts):
    """A stand-in model: counts of words and marks in the last line and in the whole context."""
    out = []
    for text in texts:
        last = text.rstrip("\n").rsplit("\n", 1)[-1]
        out.append([float(last.count(" ")), float(len(last)), float(text.count("\n")), float(text.count(last)), float("[BACK]" in last), float(text.count("[BACK]")), 1.0])
    return out


@query("job_08_probe_report", f"""
WITH {PROBE_SRC}, n AS (SELECT count(*) AS n FROM contexts) SELECT n - floor(n * 0.8)::BIGINT AS scored, true AS bounded, true AS at_least_chance FROM n""")
def _(spark, sf):
    """Contexts, vectors, a probe on four fifths of them, its report on the others."""
    report = probe_report(probe_samples(spark, sf), marker_features)
    ratio = lambda c: F.col(c).between(0, 1)
    return report.select(
        (F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")).alias("scored"), (ratio("f1") & ratio("balanced_accuracy") & (F.col("loss") > 0)).alias("bounded"),
        (F.col("balanced_accuracy") >= 0.5).alias("at_least_chance"),
    )
