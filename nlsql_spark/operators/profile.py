"""Column profiles and retrieval documents, built from whole data tables."""

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from nlsql_spark import constants as K
from nlsql_spark.functions.text import document_text, excluded_column, normalize_text
from nlsql_spark.operators.ordering import with_document_id
from nlsql_spark.session import broadcast_if_small, materialize

#: Tables that Spark estimates at no more bytes have their values counted directly.
DIRECT_BYTES = 256 << 20


def _long(df: DataFrame, cols: Sequence[str], *extra: str) -> DataFrame:
    """(extra..., column_name, value as text), one row per cell."""
    texts = df.select(*extra, *[F.col(c).cast("string").alias(c) for c in cols])
    return texts.unpivot(list(extra), list(cols), "column_name", "value")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of each column as rows (NULL counts as a value)."""
    return _long(df, cols).distinct()


def plain_double(x: Column) -> Column:
    """A double as digits without an exponent where it has at most 16 digits before and behind the point."""
    digits = F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(x)
    return F.when((size >= 1e7) & (size < 1e16) | (size < 1e-3) & (size >= 1e-10), digits).otherwise(x.cast("string"))


def column_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column as text, NULLs aside; one scan, one output row per column."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    text = lambda x, c: plain_double(x) if c in doubles else x.cast("string")
    ends = df.agg(*[F.struct(text(F.min(c), c).alias("col1"), text(F.max(c), c).alias("col2")).alias(c) for c in cols])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c)["col1"].alias("min_value"), F.col(c)["col2"].alias("max_value")) for c in cols]
    )
    return ends.select(F.inline(pairs))


def first_values(df: DataFrame, database_name: str, table_name: str, position: str) -> DataFrame:
    """``database_name, table_name, column_name, first_value``: the value of each column in the first row by ``position``."""
    cols = [c for c in df.columns if c != position] + [position]
    first = df.agg(F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), position).alias("r")).select("r.*")
    return first.unpivot([], cols, "column_name", "first_value").select(
        F.lit(database_name).alias("database_name"), F.lit(table_name).alias("table_name"), "column_name", "first_value"
    )


SUMMARY = "column_name string, value string, least long, missed long"


def frequent_summaries(cells: DataFrame, capacity: int) -> DataFrame:
    """Misra-Gries summaries of each task: values that may be frequent, each counted ``least`` times at least.

    A summary keeps ``capacity`` values per column; when there are more, the count of the first one too many is taken off all.
    What was taken off is ``missed`` (in one row per column without value): no value was seen more than ``least + missed`` times.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = {}
        missed: dict[str, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["column_name", "value"]).aggregate([([], "count_all")])
            for column, value, n in zip(*(table.column(c).to_pylist() for c in ("column_name", "value", "count_all")), strict=True):
                counts = kept.setdefault(column, {})
                counts[value] = counts.get(value, 0) + n
            for column, counts in kept.items():
                if len(counts) > capacity:
                    off = sorted(counts.values(), reverse=True)[capacity]
                    kept[column] = {v: n - off for v, n in counts.items() if n > off}
                    missed[column] = missed.get(column, 0) + off
        rows = [(c, v, n, 0) for c, counts in kept.items() for v, n in counts.items()] + [(c, None, 0, n) for c, n in missed.items()]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])

    return cells.select("column_name", "value").mapInArrow(work, SUMMARY)


def frequent_values(cells: DataFrame, k: int, capacity: int) -> tuple[DataFrame, list[str]]:
    """(column_name, value, n, first_pos of values that may be among the ``k`` most frequent, columns for which it is proven).

    Only summaries and the counts of candidates are shuffled. It is proven for a column if its k-th exact count is above
    all that a value outside the candidates can have, or if no summary left out anything.
    """
    summary = materialize(frequent_summaries(cells, capacity))
    missed = summary.groupBy("column_name").agg(F.sum("missed").alias("missed"))
    seen = summary.filter("value is not null").groupBy("column_name", "value").agg(F.sum("least").alias("least"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("least")))
    kth = seen.withColumn("rank", rank).filter(F.col("rank") == k).select("column_name", F.col("least").alias("border"))
    bounds = missed.join(kth, "column_name", "left")
    wanted = seen.join(F.broadcast(bounds), "column_name").filter(F.col("least") + F.col("missed") >= F.coalesce("border", F.lit(0)))
    wanted = broadcast_if_small(materialize(wanted.select("column_name", "value")))
    exact = materialize(_count_values(cells.join(wanted, ["column_name", "value"], "left_semi")))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n")))
    reached = exact.withColumn("rank", rank).filter(F.col("rank") == k).select("column_name", F.col("n").alias("reached"))
    # one row per column
    proof = missed.join(reached, "column_name", "left").filter((F.col("missed") == 0) | (F.col("reached") > F.col("missed")))
    return exact, [r["column_name"] for r in proof.collect()]


def _count_values(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column_name", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def values_by_hash(cells: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    """The same where no value stands out (a key, say): counts go by a 64-bit hash, and only the best values are fetched.

    A hash that two of the fetched values share, or that hides a value, shows in the counts; such columns are not proven.
    """
    hashed = cells.withColumn("hash", F.xxhash64("value"))
    counts = hashed.groupBy("column_name", "hash").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "first_pos")
    best = F.broadcast(materialize(counts.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k)).drop("rank"))
    # k rows per column, as positions differ
    fetched = materialize(_count_values(hashed.join(best.select("column_name", "hash"), ["column_name", "hash"], "left_semi")))
    same = fetched.withColumn("hash", F.xxhash64("value")).join(best.withColumnsRenamed({"n": "all", "first_pos": "_first"}), ["column_name", "hash"])
    return fetched, [r["column_name"] for r in same.groupBy("column_name").agg(F.bool_and(F.col("n") == F.col("all")).alias("ok")).filter("ok").collect()]


def top_values(df: DataFrame, cols: Sequence[str], position: str, k: int = K.TOP_VALUES, capacity: int = 4_096, direct_bytes: int = DIRECT_BYTES) -> DataFrame:
    """The ``k`` most frequent values of each column; ties go to the value seen first by ``position``.

    A table that Spark holds for small is counted as it is. A larger one is summed up in its tasks, and only values that can win are
    counted exactly (``frequent_values``); columns without frequent values are counted by hash, and what is still open in full.
    """
    cells = _long(df.withColumn("__pos", F.col(position)), cols, "__pos").withColumnRenamed("__pos", "pos").filter("value is not null")
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "first_pos", "value")
    best = lambda counts: counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= direct_bytes:
        return best(_count_values(cells))
    found, todo = [], list(cols)
    for way in (lambda c: frequent_values(c, k, capacity), lambda c: values_by_hash(c, k)):
        if todo:
            counts, proven = way(cells.filter(F.col("column_name").isin(todo)))
            found.append(counts.filter(F.col("column_name").isin(proven)))
            todo = [c for c in todo if c not in proven]
    if todo:
        found.append(_count_values(cells.filter(F.col("column_name").isin(todo))))
    return best(reduce(DataFrame.unionByName, found))


def column_profiles(
    df: DataFrame, database_name: str, table_name: str, formats: dict[str, str], position: str, k: int = K.TOP_VALUES
) -> DataFrame:
    """``database_name, table_name, column_name, values_text`` for the columns of one data table."""
    spans = [c for c, fmt in formats.items() if fmt in K.RANGE_FORMATS]
    texts = [c for c, fmt in formats.items() if fmt == "text"]
    parts: list[DataFrame] = []
    if spans:
        ends = column_range(df, spans)
        parts.append(ends.select("column_name", F.concat_ws(" ", "min_value", "max_value").alias("values_text")))
    if texts:
        top = top_values(df, texts, position, k)
        listed = F.array_sort(F.collect_list(F.struct("rank", "value")))  # at most k per column
        parts.append(
            top.groupBy("column_name")
            .agg(listed.alias("t"))
            .select("column_name", normalize_text(F.array_join("t.value", " ")).alias("values_text"))
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        F.lit(database_name).alias("database_name"), F.lit(table_name).alias("table_name"), "column_name", "values_text"
    )


def build_documents(catalog: DataFrame, descriptions: DataFrame, values: DataFrame, **numbering) -> DataFrame:
    """Column, its description and its value profile, with a sequential document id over all columns.

    ``descriptions``: database_name, table_name, original_column_name, column_description, data_format.
    ``values``: database_name, table_name, column_name and whatever describes the values.
    """
    on = ["database_name", "table_name", "column_name"]
    described = descriptions.select(
        "database_name", "table_name", F.col("original_column_name").alias("column_name"),
        F.col("column_description").alias("col_description"), F.col("data_format").alias("col_data_format"),
    )
    joined = catalog.join(described, on, "left").join(values, on, "left")
    numbered = with_document_id(joined, ["database_name", "table_pos", "table_name", "column_pos"], **numbering)
    extra = [c for c in values.columns if c not in on]
    return numbered.select(
        "document_id", "database_name", "table_name", F.col("column_name").alias("col_name"),
        "is_primary_key", "is_foreign_key", "col_description", "col_data_format", *extra,
    )


def document_texts(
    documents: DataFrame,
    *,
    description: bool = True,
    data_format: bool = True,
    values_text: Column | None = None,
    first_value: Column | None = None,
    **exclusions: bool,
) -> DataFrame:
    """``example_id, input_to_embed`` of all columns that no exclusion rule removes."""
    is_key = F.col("is_primary_key") | F.col("is_foreign_key")
    first = F.lit(None).cast("string") if first_value is None else first_value
    out = excluded_column(is_key, F.col("col_data_format"), F.col("col_name"), first, **exclusions)
    text = document_text(
        F.col("table_name"),
        F.col("col_name"),
        F.col("col_description") if description else None,
        F.col("col_data_format") if data_format else None,
        values_text,
        out,
    )
    return documents.select(F.col("document_id").alias("example_id"), text.alias("input_to_embed")).filter(
        "input_to_embed is not null"
    )
