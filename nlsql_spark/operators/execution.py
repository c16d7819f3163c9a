"""Run truth and predicted queries and compare their result sets.

Each distinct query text is its own Spark job over the tables of its database; the driver only submits them, a
bounded number at a time. A text is submitted as a subquery, which can hold neither changes nor commands. Rows
stay inside the query: its job ends in one row, a fingerprint of the set of its rows, and fingerprints are compared.
"""

import itertools
import re
import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlsql_spark.session import shared_dir

#: rows, sum1, sum2: how many distinct rows a result has, and two sums of independent 64-bit hashes over them.
FINGERPRINT = "rows long, sum1 decimal(38,0), sum2 decimal(38,0)"
STATUS_SCHEMA = f"text_id long, ok boolean, error string, {FINGERPRINT}"
_READ_ONLY = re.compile(r"\s*(select|with)\b", re.IGNORECASE)
# Texts that are submitted before their states are written out.
WINDOW = 512


def _is_query(sql: str | None) -> bool:
    return bool(sql and _READ_ONLY.match(sql))


def as_subquery(sql: str) -> str:
    """The text inside a FROM clause, where the parser takes a query and nothing else."""
    return f"SELECT * FROM (\n{re.sub(r'[;\s]+$', '', sql)}\n)"


def is_executable(spark: SparkSession, sql: str | None) -> bool:
    """Whether a read-only statement parses and its names resolve; nothing is run. Blank is not."""
    if not _is_query(sql):
        return False
    try:
        spark.sql(as_subquery(sql)).schema
        return True
    except Exception:  # parse and analysis errors of any kind mean: not executable
        return False


def executable_flags(spark: SparkSession, df: DataFrame, sql_col: str, key: str = "question_id") -> DataFrame:
    """``key, executable`` for a table of query texts.

    Spark resolves names on the driver, so each distinct text passes there once, in bounded windows; the rows do not.
    """
    texts = df.select(F.col(sql_col).alias("__text")).filter(F.col(sql_col).isNotNull()).distinct()
    folder = f"{shared_dir(spark)}/flags-{uuid.uuid4()}"
    schema = "__text string, executable boolean"
    spark.createDataFrame([], schema).write.parquet(folder)
    for window in itertools.batched((row[0] for row in texts.toLocalIterator()), WINDOW):
        flags = [(text, is_executable(spark, text)) for text in window]
        spark.createDataFrame(flags, schema).write.mode("append").parquet(folder)
    known = spark.read.schema(schema).parquet(folder)
    joined = df.select(key, F.col(sql_col).alias("__text")).join(known, "__text", "left")
    return joined.select(key, F.coalesce("executable", F.lit(False)).alias("executable"))


def value_key(c: Column, data_type: T.DataType) -> Column:
    """A text that is equal exactly for equal values: 1 = 1.0 = true, but a number is not its text."""
    if isinstance(data_type, T.BooleanType):
        return F.concat(F.lit("n"), c.cast("int").cast("string"))
    if isinstance(data_type, T.IntegralType):
        return F.concat(F.lit("n"), c.cast("string"))
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        number = c.cast("double")
        whole = (F.abs(number) < 1e37) & (F.floor(number) == number)
        text = F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
        if isinstance(data_type, T.DecimalType):
            # a decimal that no double holds is compared by its own digits
            exact = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
            text = F.when(number.cast(data_type) == c, text).otherwise(F.regexp_replace(exact, r"\.$", ""))
        return F.concat(F.lit("n"), text)
    return F.concat(F.lit("s"), c.cast("string"))


def row_keys(df: DataFrame) -> DataFrame:
    """The distinct rows of a result as ``row_key``; column order counts, column names do not."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [value_key(F.col(f"c{i}"), field.dataType) for i, field in enumerate(df.schema.fields)]
    return named.select(F.to_json(F.array(*cells)).alias("row_key")).distinct()


def results_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``matched``: equal as sets of rows (order-free, duplicates aside, NULL equals NULL)."""
    sides = row_keys(a).select("row_key", F.lit(1).alias("s")).unionByName(row_keys(b).select("row_key", F.lit(2).alias("s")))
    seen = sides.groupBy("row_key").agg(F.count("*").alias("n"))
    return seen.agg(F.coalesce(F.bool_and(F.col("n") == 2), F.lit(True)).alias("matched"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that is equal for equal sets of rows, whatever their order and number of copies.

    Sums of hashes do not depend on the order, so they are combined in tasks; different sets have equal ones with a
    probability of about 2^-128.
    """
    total = lambda *salt: F.coalesce(F.sum(F.xxhash64(*salt, "row_key").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    # the second hash reads another text, so that the two are not a function of each other
    return row_keys(df).agg(F.count("*").alias("rows"), total().alias("sum1"), total(F.lit(7), F.reverse("row_key")).alias("sum2"))


def _run_one(spark: SparkSession, text_id: int, sql: str | None, timeout_s: float):
    """One query's fingerprint; a failing, forbidden or late query only leaves a status."""
    if not _is_query(sql):
        return (text_id, False, "not a single read-only statement", None, None, None)
    group = f"nlsql-{uuid.uuid4()}"
    ended, late = threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not ended.wait(0.2):  # a query may be between two of its jobs
            spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, f"query {text_id}", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, stop)
    timer.start()
    try:
        return (text_id, True, None, *fingerprint(spark.sql(as_subquery(sql))).first())
    except Exception as error:
        return (text_id, False, "timeout" if late.is_set() else str(error).split("\n")[0][:500], None, None, None)
    finally:
        ended.set()
        timer.cancel()


def execution_match(
    spark: SparkSession,
    pairs: DataFrame | Iterable[tuple],
    timeout_s: float = 30.0,
    parallel: int = 8,
    strict_errors: bool = False,
    bind: Callable[[SparkSession, str], None] | None = None,
) -> DataFrame:
    """``question_id, matched, error`` for (question_id, truth_sql, predicted_sql[, database_name]) pairs.

    With ``bind`` each database gets a session of its own: ``bind(session, database_name)`` registers its tables
    there as views, so databases may have tables of equal names. Every distinct text of a database runs once.
    A failed query counts as an empty result (so two failures match); ``strict_errors`` makes any
    failure a mismatch. A timeout is always a mismatch. Only query texts pass through the driver.
    """
    if not isinstance(pairs, DataFrame):
        rows = [(*row, None)[:4] for row in pairs]
        pairs = spark.createDataFrame(rows, "question_id long, truth_sql string, predicted_sql string, database_name string")
    if "database_name" not in pairs.columns:
        pairs = pairs.withColumn("database_name", F.lit(None).cast("string"))
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4()}"
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_sql").alias("sql")) for s in ("truth", "predicted")])
    asked = pairs.select("question_id", "database_name", F.explode(sides).alias("x")).select("question_id", "database_name", "x.*")
    asked = asked.withColumn("text_id", F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in ("database_name", "sql")]))
    sessions: dict[str, SparkSession] = {}

    def session_of(name: str | None) -> SparkSession:
        if bind is None or name is None:
            return spark
        if name not in sessions:
            sessions[name] = spark.newSession()
            bind(sessions[name], name)
        return sessions[name]

    spark.createDataFrame([], STATUS_SCHEMA).write.parquet(f"{folder}/states")
    texts = asked.select("text_id", "database_name", "sql").dropDuplicates(["text_id"])
    with ThreadPoolExecutor(parallel) as pool:
        for window in itertools.batched(texts.toLocalIterator(), WINDOW):
            jobs = [(session_of(row["database_name"]), row["text_id"], row["sql"], timeout_s) for row in window]
            states = list(pool.map(lambda job: _run_one(*job), jobs))
            spark.createDataFrame(states, STATUS_SCHEMA).write.mode("append").parquet(f"{folder}/states")
    states = asked.join(spark.read.schema(STATUS_SCHEMA).parquet(f"{folder}/states"), "text_id")
    # a failed query counts as the empty result
    prints = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("rows", "sum1", "sum2")])
    per_question = states.groupBy("question_id").agg(
        (F.min(prints) == F.max(prints)).alias("same"),
        F.bool_and("ok").alias("ok"),
        F.bool_or(F.coalesce(F.col("error") == "timeout", F.lit(False))).alias("late"),
        F.max("error").alias("error"),
    )
    matched = F.col("same") & ~F.col("late")
    if strict_errors:
        matched = matched & F.col("ok")
    return per_question.select("question_id", matched.alias("matched"), "error")
