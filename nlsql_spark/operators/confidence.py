"""Model confidence around correction markers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlsql_spark import constants as K

BLOCK = 65_536


def step_confidence(beam_probs: DataFrame) -> DataFrame:
    """Per question and step: mean and sample deviation over beams of the highest token probability.

    ``beam_probs``: question_id, step, beam, prob (one row per vocabulary entry). One beam has no deviation.
    """
    top = beam_probs.groupBy("question_id", "step", "beam").agg(F.max("prob").alias("p"))
    return top.groupBy("question_id", "step").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"))


def marker_confidence(
    tokens: DataFrame,
    is_marker: Column,
    sequence: str = "question_id",
    position: str = "position",
    radius: int = K.CONFIDENCE_RADIUS,
    block: int = BLOCK,
) -> DataFrame:
    """Mean confidence (x 100) of the ``radius`` tokens before and ``radius - 1`` after each marker.

    ``tokens``: sequence, dense 0-based position, mean, std. A token's score is that of the next step;
    the last token has none. Windows stop at the ends of a sequence. Long sequences are cut into blocks
    that overlap by the reach of a window, so no task has to hold a whole one.
    """
    reach = radius + 1
    own = F.floor(F.col(position) / block)
    first = F.greatest(F.floor((F.col(position) - reach) / block), F.lit(0))
    last = F.floor((F.col(position) + reach) / block)
    spread = tokens.select(
        sequence, position, "mean", "std", is_marker.alias("__marker"), own.alias("__own"),
        F.explode(F.sequence(first, last)).alias("__block"),
    )
    ordered = Window.partitionBy(sequence, "__block").orderBy(position)
    shifted = spread.withColumns({"__m": F.lead("mean").over(ordered), "__s": F.lead("std").over(ordered)})
    before = ordered.rowsBetween(-radius, -1)
    after = ordered.rowsBetween(1, radius - 1)
    scored = shifted.withColumns(
        {
            "mean_before": 100 * F.avg("__m").over(before),
            "std_before": 100 * F.avg("__s").over(before),
            "mean_after": 100 * F.avg("__m").over(after),
            "std_after": 100 * F.avg("__s").over(after),
        }
    )
    return scored.filter((F.col("__block") == F.col("__own")) & F.col("__marker")).select(
        sequence, position, "mean_before", "std_before", "mean_after", "std_after"
    )


def confidence_per_sequence(windows: DataFrame, sequence: str = "question_id", position: str = "position") -> DataFrame:
    """The marker windows of a sequence as one ordered list of (before, after) scores."""
    pair = F.struct(
        F.col(position).alias("position"),
        F.struct(F.col("mean_before").alias("mean"), F.col("std_before").alias("std")).alias("before"),
        F.struct(F.col("mean_after").alias("mean"), F.col("std_after").alias("std")).alias("after"),
    )
    listed = windows.groupBy(sequence).agg(F.array_sort(F.collect_list(pair)).alias("scores"))
    return listed.withColumn("scores", F.transform("scores", lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after"))))
