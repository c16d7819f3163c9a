"""Link scores: false-positive rate, recall, column recall."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark.functions.binding import let
from nlsql_spark.operators.linking import LINKS_TYPE

LINK = ["question_id", "table_name", "column_name"]


def link_set_ops(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Every distinct (question, table, column) with ``in_pred`` and ``in_truth``.

    One shuffle on the whole link, with duplicates removed before it, so no question can be hot.
    """
    both = pred.select(*LINK, F.lit(True).alias("p"), F.lit(False).alias("t")).unionByName(
        truth.select(*LINK, F.lit(False).alias("p"), F.lit(True).alias("t"))
    )
    return both.groupBy(*LINK).agg(F.bool_or("p").alias("in_pred"), F.bool_or("t").alias("in_truth"))


def question_link_counts(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Per question: number of predicted, true and common links.

    ``questions`` (question_id) adds the questions that have no link on either side.
    """
    counts = link_set_ops(pred, truth).groupBy("question_id").agg(
        F.count_if("in_pred").alias("n_pred"),
        F.count_if("in_truth").alias("n_truth"),
        F.count_if(F.col("in_pred") & F.col("in_truth")).alias("n_both"),
    )
    if questions is None:
        return counts
    return questions.select("question_id").join(counts, "question_id", "left").na.fill(0, ["n_pred", "n_truth", "n_both"])


def _pair_names(links: Column) -> Column:
    """The distinct (table, column) pairs of a link list, as texts."""
    per_table = lambda x: F.transform(x["columns"], lambda c: F.concat_ws("\x00", x["table_name"], c))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(links, F.array().cast(LINKS_TYPE)), per_table)))


def _plain(links: Column) -> Column:
    """No table comes twice, no name is NULL or holds the sign that joins the names of a pair."""
    tables = F.transform(links, lambda x: x["table_name"])
    names = lambda x: F.concat(F.coalesce(x["table_name"], F.lit("\x00")), F.array_join(x["columns"], "", "\x00"))
    return (F.size(F.array_distinct(tables)) == F.size(tables)) & F.forall(links, lambda x: ~F.contains(names(x), F.lit("\x00")))


def _pair_counts(p: Column, t: Column) -> Column:
    """How many distinct pairs two link lists have, and how many they have in common. Plain lists are counted table by table,
    which makes no text for a pair."""
    total = lambda links, f: F.aggregate(links, F.lit(0), lambda n, x: n + f(x))
    same = lambda x, y: F.when(x["table_name"] == y["table_name"], F.size(F.array_intersect(x["columns"], y["columns"]))).otherwise(0)
    distinct = lambda x: F.size(F.array_distinct(x["columns"]))
    counts = lambda *n: F.struct(*(c.cast("long").alias(name) for c, name in zip(n, ("n_pred", "n_truth", "n_both"))))
    plain = counts(total(p, distinct), total(t, distinct), total(p, lambda x: total(t, lambda y: same(x, y))))
    by_name = let(
        F.struct(_pair_names(p).alias("p"), _pair_names(t).alias("t")),
        lambda x: counts(F.size(x["p"]), F.size(x["t"]), F.size(F.array_intersect(x["p"], x["t"]))),
    )
    return F.when(_plain(p) & _plain(t), plain).otherwise(by_name)


def nested_link_counts(pred: DataFrame, truth: DataFrame | str) -> DataFrame:
    """The same counts from link lists (question_id, schema_links), one row a question on each side.

    Pairs are compared inside the row, so the shuffle carries questions and not single links. ``truth`` may be a column
    of ``pred`` that holds the true links of the same question: then nothing is shuffled.
    """
    if isinstance(truth, str):
        joined = pred.select("question_id", F.col("schema_links").alias("p"), F.col(truth).alias("t"))
    else:
        joined = pred.select("question_id", F.col("schema_links").alias("p")).join(
            truth.select("question_id", F.col("schema_links").alias("t")), "question_id", "full_outer"
        )
    return joined.select("question_id", _pair_counts(F.col("p"), F.col("t")).alias("n")).select("question_id", "n.*")


def nested_link_metrics(pred: DataFrame, truth: DataFrame | str, *more: tuple[DataFrame, DataFrame | str]) -> DataFrame:
    """All three scores from link lists; ``more``: further questions, as pairs of predictions and truth."""
    counts = [nested_link_counts(*sides) for sides in ((pred, truth), *more)]
    return _scores(reduce(DataFrame.unionByName, counts))


def _scores(counts: DataFrame) -> DataFrame:
    return counts.agg(
        _fpr().alias("false_positive_rate"), _recall().alias("recall"), _column_recall().alias("column_recall"),
        F.count("*").alias("questions"),
    )


def _fpr():
    n_pred, n_both = F.sum("n_pred"), F.sum("n_both")
    return F.coalesce(F.try_divide((n_pred - n_both).cast("double"), n_pred), F.lit(0.0))


def _recall():
    return F.avg((F.col("n_both") == F.col("n_truth")).cast("double"))


def _column_recall():
    return F.avg(F.try_divide(F.col("n_both").cast("double"), F.col("n_truth")))


def link_fpr(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Share of predicted links that are not true, over all questions together; 0 without predictions."""
    return question_link_counts(pred, truth, questions).agg(_fpr().alias("false_positive_rate"))


def link_recall(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Share of questions whose true links are all predicted."""
    return question_link_counts(pred, truth, questions).agg(_recall().alias("recall"))


def column_recall(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Mean share of true links found; questions without true links are left out and counted."""
    return question_link_counts(pred, truth, questions).agg(
        _column_recall().alias("column_recall"), F.count_if(F.col("n_truth") == 0).alias("without_truth")
    )


def link_metrics(pred: DataFrame, truth: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """All three scores in one pass."""
    return _scores(question_link_counts(pred, truth, questions))


def assert_same_ids(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """The common ids; fails on an id (or a number of rows of an id) that only one side has."""
    left = a.groupBy(key).agg(F.count("*").alias("na"))
    right = b.groupBy(key).agg(F.count("*").alias("nb"))
    joined = left.join(right, key, "full_outer")
    same = F.col("na").eqNullSafe(F.col("nb"))
    problem = F.raise_error(F.concat(F.lit("predictions and truth differ on id "), F.col(key).cast("string")))
    return joined.select(F.when(same, F.col(key)).otherwise(problem.cast(joined.schema[key].dataType)).alias(key))
