"""Scores of predicted queries: execution accuracy, valid-efficiency score, training-log roll-up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlsql_spark.functions.rewards import ves_reward


def pair_results(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth with the prediction of the same question.

    Of several predictions the last by ``pos`` counts; a missing one stays NULL and is ``missing``.
    """
    last = predictions.groupBy("question_id").agg(F.max_by("sql", "pos").alias("predicted_sql"))
    paired = truth.join(last.withColumn("__found", F.lit(True)), "question_id", "left")
    return paired.withColumn("missing", F.col("__found").isNull()).drop("__found")


def count_by_difficulty(truth: DataFrame) -> DataFrame:
    return truth.groupBy("difficulty").agg(F.count("*").alias("n"))


def execution_accuracy(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """``level, accuracy, n`` per difficulty and OVERALL; questions without a match row count as wrong."""
    one = matches.groupBy("question_id").agg(F.max(F.col("matched").cast("int")).alias("hit"))
    joined = truth.join(one, "question_id", "left")
    scores = joined.rollup("difficulty").agg(
        (100 * F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("accuracy"),
        F.count("*").alias("n"),
        F.grouping("difficulty").alias("total"),
    )
    return scores.select(
        F.when(F.col("total") == 1, F.lit("OVERALL")).otherwise(F.col("difficulty")).alias("level"), "accuracy", "n"
    )


def drop_outliers(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """Keep values strictly within ``k`` population standard deviations of their group's mean.

    A group of equal values keeps them all. The statistics are combined before the shuffle and joined
    back, so a hot key is never sorted into one window.
    """
    stats = df.groupBy(key).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    inside = F.abs(F.col(value) - F.col("__mean")) < k * F.col("__sd")
    return df.join(stats, key).filter(inside | (F.col("__lo") == F.col("__hi"))).drop("__mean", "__sd", "__lo", "__hi")


def question_efficiency(timings: DataFrame, matches: DataFrame) -> DataFrame:
    """Per question: mean truth / prediction time ratio without outliers, and sqrt(reward); 0 if wrong.

    ``timings``: question_id, truth_seconds, predicted_seconds, one row per timed run.
    """
    ratios = timings.select("question_id", (F.col("truth_seconds") / F.col("predicted_seconds")).alias("ratio"))
    mean = drop_outliers(ratios, "question_id", "ratio").groupBy("question_id").agg(F.avg("ratio").alias("time_ratio"))
    joined = matches.join(mean, "question_id", "left")
    score = F.when(F.col("matched") & F.col("time_ratio").isNotNull(), F.sqrt(ves_reward(F.col("time_ratio"))))
    return joined.select("question_id", "matched", "time_ratio", F.coalesce(score, F.lit(0.0)).alias("score"))


def valid_efficiency_score(timings: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: ``ves`` = 100 x mean score over all questions, and their number."""
    scored = question_efficiency(timings, matches)
    return scored.agg((100 * F.sum("score") / F.count("*")).alias("ves"), F.count("*").alias("n"))


def training_log_summary(df: DataFrame) -> DataFrame:
    """Mean loss over devices per step and its perplexity. ``df``: step, device, loss."""
    return df.groupBy("step").agg(F.avg("loss").alias("avg_loss")).withColumn("perplexity", F.exp("avg_loss"))
