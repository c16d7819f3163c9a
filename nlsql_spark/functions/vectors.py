"""Vector columns (ARRAY<FLOAT> / ARRAY<DOUBLE>)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nlsql_spark.functions.binding import let
from nlsql_spark.functions.draws import digest, uniform


def l2_normalize(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # the norm is bound to a name: inside the lambda it would be summed again for every element
    return let(F.greatest(F.sqrt(squares), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x / norm))


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d * d)


def hash_vector(key: Column, dim: int, seed: int = 0) -> Column:
    """A repeatable stand-in vector: ``dim`` uniform draws from the key's digest.

    The digest is the repeated item, so a long key is hashed once and not per dimension.
    """
    return F.transform(F.array_repeat(digest(key), dim), lambda h, i: uniform(F.lit(seed), h, i))
