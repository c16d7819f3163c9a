"""Frequent values in two passes against plain counting, with summaries far too small."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import profile as P


def rows_of(seed):
    rng = random.Random(seed)
    zipf = lambda n: f"v{int(n * rng.random() ** 4)}"
    return [(i, zipf(300), f"key{i}", rng.choice(["a", "b", None]), f"pair{i // 2}", zipf(5) if i > 900 else f"early{i % 400}") for i in range(1500)]


def plain(rows, place, k):
    n, first = Counter(), {}
    for r in rows:
        if r[place] is not None:
            n[r[place]] += 1
            first.setdefault(r[place], r[0])
    best = sorted(n, key=lambda v: (-n[v], first[v], v))[:k]
    return [(v, n[v], first[v], i + 1) for i, v in enumerate(best)]


@pytest.mark.parametrize("capacity", [2, 20, 5000])
@pytest.mark.parametrize("k", [1, 5])
def test_two_passes_equal_counting(spark, capacity, k):
    rows = rows_of(capacity)
    cols = ["zipf", "key", "few", "pair", "late"]
    df = spark.createDataFrame(rows, "pos long, zipf string, key string, few string, pair string, late string").repartition(6)
    out = P.top_values(df, cols, "pos", k, capacity=capacity, direct_bytes=0).collect()
    got = {c: sorted(((r["value"], r["n"], r["first_pos"], r["rank"]) for r in out if r["column_name"] == c), key=lambda r: r[3]) for c in cols}
    assert got == {c: plain(rows, 1 + i, k) for i, c in enumerate(cols)}


def test_what_is_proven(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"x{i}", f"key{i}") for i in range(3000)], "pos long, a string, b string").repartition(5)
    cells = df.unpivot("pos", ["a", "b"], "column_name", "value")
    counts, proven = P.frequent_values(cells, 1, 50)
    assert proven == ["a"] and counts.filter("column_name = 'a' and value = 'hot'").first()["n"] == 2000
    _, by_hash = P.values_by_hash(cells.filter("column_name = 'b'"), 4)
    assert by_hash == ["b"]
    summary = P.frequent_summaries(cells, 50)
    assert summary.groupBy(F.spark_partition_id(), "column_name").count().agg(F.max("count")).first()[0] <= 51
