"""Score columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ves_reward(ratio: Column) -> Column:
    """Reward step of a truth-to-prediction time ratio."""
    return (
        F.when(ratio == 0, F.lit(0.0))
        .when(ratio >= 2, F.lit(1.25))
        .when(ratio >= 1, F.lit(1.0))
        .when(ratio >= 0.5, F.lit(0.75))
        .when(ratio >= 0.25, F.lit(0.5))
        .otherwise(F.lit(0.25))
    )
