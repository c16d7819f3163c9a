"""Schema catalogues: introspection, key resolution, and the nested form the linkers join with.

A flat catalogue has one row per column:
``database_name, table_name, table_pos, column_name, column_pos, data_format, default_value,
is_not_null, is_primary_key, is_foreign_key``. Keys are
``database_name, table_name, constraint_id, kind ('pk' | 'fk'), seq, local_column, ref_table, ref_column``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark.functions.ddl import column_line, foreign_key_line, quoted_names
from nlsql_spark.functions.text import normalize_identifier

CATALOG_COLUMNS = [
    "database_name", "table_name", "table_pos", "column_name", "column_pos", "data_format",
    "default_value", "is_not_null", "is_primary_key", "is_foreign_key",
]
KEYS_SCHEMA = (
    "database_name string, table_name string, constraint_id int, kind string, seq int, "
    "local_column string, ref_table string, ref_column string"
)
SYSTEM_TABLES = ["sqlite_sequence"]


def introspect(
    spark: SparkSession, tables: dict[str, DataFrame], database_name: str, keys: DataFrame | None = None
) -> DataFrame:
    """Describe the given tables from their Spark schemas; declared ``keys`` set the flags."""
    rows = [
        (database_name, table, t, field.name, c, field.dataType.simpleString(), None, not field.nullable)
        for t, (table, df) in enumerate((n, d) for n, d in tables.items() if n not in SYSTEM_TABLES)
        for c, field in enumerate(df.schema.fields)
    ]
    flat = spark.createDataFrame(
        rows,
        "database_name string, table_name string, table_pos int, column_name string, column_pos int, "
        "data_format string, default_value string, is_not_null boolean",
    )
    flat = flat.withColumns({c: normalize_identifier(F.col(c)) for c in ("table_name", "column_name")})
    if keys is None:
        return flat.withColumns({"is_primary_key": F.lit(False), "is_foreign_key": F.lit(False)})
    return flag_keys(flat, keys)


def flag_keys(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Primary / foreign key flags by normalised column name."""
    on = ["database_name", "table_name", "column_name"]
    flags = keys.groupBy(
        "database_name",
        normalize_identifier(F.col("table_name")).alias("table_name"),
        normalize_identifier(F.col("local_column")).alias("column_name"),
    ).agg(
        F.bool_or(F.col("kind") == "pk").alias("is_primary_key"),
        F.bool_or(F.col("kind") == "fk").alias("is_foreign_key"),
    )
    flagged = catalog.drop("is_primary_key", "is_foreign_key").join(flags, on, "left")
    return flagged.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_primary_key", "is_foreign_key")}
    ).select(*[c for c in CATALOG_COLUMNS])


def resolve_foreign_keys(keys: DataFrame) -> DataFrame:
    """Fill an absent referenced column with the referenced table's only primary-key column.

    A foreign key with an absent column that has several columns, or whose target has no single
    primary-key column, is dropped.
    """
    names = {c: normalize_identifier(F.col(c)) for c in ("table_name", "local_column", "ref_table", "ref_column")}
    keys = keys.withColumns(names)
    single_pk = (
        keys.filter(F.col("kind") == "pk")
        .groupBy("database_name", F.col("table_name").alias("ref_table"))
        .agg(F.count("*").alias("n"), F.min("local_column").alias("pk_column"))
        .filter("n = 1")
        .drop("n")
    )
    fks = keys.filter(F.col("kind") == "fk")
    shape = fks.groupBy("database_name", "table_name", "constraint_id").agg(
        F.count("*").alias("width"), F.bool_or(F.col("ref_column").isNull()).alias("open")
    )
    resolved = (
        fks.join(shape, ["database_name", "table_name", "constraint_id"])
        .join(single_pk, ["database_name", "ref_table"], "left")
        .filter(~F.col("open") | ((F.col("width") == 1) & F.col("pk_column").isNotNull()))
        .withColumn("ref_column", F.coalesce("ref_column", "pk_column"))
    )
    return keys.filter(F.col("kind") == "pk").unionByName(resolved.select(*keys.columns))


def _ordered(struct_cols: list[str | Column]) -> Column:
    return F.array_sort(F.collect_list(F.struct(*struct_cols)))


def columns_per_table(catalog: DataFrame) -> DataFrame:
    """One row per table with its columns in position order."""
    return (
        catalog.groupBy("database_name", "table_name")
        .agg(
            F.min("table_pos").alias("table_pos"),
            _ordered(["column_pos", "column_name", "is_primary_key", "is_foreign_key"]).alias("columns"),
        )
    )


def identifier_pool(catalog: DataFrame) -> DataFrame:
    """The distinct table and column names of each database."""
    return catalog.groupBy("database_name").agg(
        F.array_sort(F.collect_set("table_name")).alias("tables"),
        F.array_sort(F.collect_set("column_name")).alias("columns"),
    )


def nest_catalog(catalog: DataFrame, keys: DataFrame | None = None, examples: DataFrame | None = None) -> DataFrame:
    """One row per database: ``tables ARRAY<STRUCT<...>>`` in table order.

    A group is one database's schema, so its size is bounded by what a database can declare. ``examples``
    holds at most a few sample rows per table: ``database_name, table_name, row_no, values ARRAY<STRING>``.
    """
    on = ["database_name", "table_name"]
    tables = catalog.groupBy(*on).agg(
        F.min("table_pos").alias("table_pos"),
        _ordered(
            ["column_pos", "column_name", "data_format", "default_value", "is_not_null",
             "is_primary_key", "is_foreign_key"]
        ).alias("columns"),
    )
    if keys is not None:
        constraint = keys.groupBy(*on, "constraint_id", "kind").agg(
            F.max("ref_table").alias("ref_table"), _ordered(["seq", "local_column", "ref_column"]).alias("links")
        )
        per_table = constraint.groupBy(*on).agg(
            F.flatten(F.collect_list(F.when(F.col("kind") == "pk", F.col("links.local_column")))).alias("pk"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("kind") == "fk",
                        F.struct(
                            "constraint_id",
                            F.col("links.local_column").alias("local"),
                            "ref_table",
                            F.col("links.ref_column").alias("ref"),
                        ),
                    )
                )
            ).alias("fks"),
        )
        tables = tables.join(per_table, on, "left")
    else:
        tables = tables.withColumn("pk", F.lit(None).cast("array<string>")).withColumn(
            "fks",
            F.lit(None).cast("array<struct<constraint_id:int,local:array<string>,ref_table:string,ref:array<string>>>"),
        )
    if examples is not None:
        rows = examples.groupBy(*on).agg(_ordered(["row_no", "values"]).alias("r"))
        tables = tables.join(rows.select(*on, F.col("r.values").alias("examples")), on, "left")
    else:
        tables = tables.withColumn("examples", F.lit(None).cast("array<array<string>>"))
    pk_flags = F.transform(F.filter("columns", lambda c: c["is_primary_key"]), lambda c: c["column_name"])
    tables = tables.withColumns(
        {
            "pk": F.coalesce("pk", pk_flags),
            "fks": F.coalesce(F.col("fks"), F.array().cast(tables.schema["fks"].dataType)),
            "examples": F.coalesce(F.col("examples"), F.array().cast("array<array<string>>")),
        }
    )
    # the text of each column and key is made here, once per table, not once per question
    single_pk = F.size("pk") == 1
    tables = tables.withColumns(
        {
            "columns": F.transform(
                "columns", lambda c: c.withField("line", column_line(c, single_pk)).withField("key", F.lower(c["column_name"]))
            ),
            "fks": F.transform("fks", lambda fk: fk.withField("line", foreign_key_line(fk))),
            "pk_line": F.concat(F.lit("PRIMARY KEY ("), quoted_names(F.col("pk")), F.lit(")")),
        }
    )
    # and so are the lists that links are compared with
    names = F.transform("columns", lambda c: c["column_name"])
    keyed = F.filter("columns", lambda c: c["is_primary_key"] | c["is_foreign_key"])
    tables = tables.withColumns(
        {
            "key": F.lower("table_name"),
            "names": names,
            "key_names": F.transform(keyed, lambda c: c["column_name"]),
            "distinct_names": F.size(F.array_distinct(names)) == F.size(names),
        }
    )
    parts = ["table_pos", "table_name", "columns", "pk", "pk_line", "fks", "examples", "key", "names", "key_names", "distinct_names"]
    return tables.groupBy("database_name").agg(_ordered(parts).alias("tables"))


def resolve_columns(query_tables: DataFrame, query_columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name the table of every column a query uses.

    ``query_tables``: question_id, database_name, name, alias. ``query_columns``: question_id,
    database_name, qualifier ('' if none), column_name. A qualifier is a table name or else an alias;
    unqualified columns (and unknown qualifiers) go to every used table that has such a column.
    """
    by_name = query_tables.select("question_id", F.col("name").alias("qualifier"), F.col("name").alias("n")).distinct()
    by_alias = (
        query_tables.filter(F.col("alias") != "")
        .groupBy("question_id", F.col("alias").alias("qualifier"))
        .agg(F.min("name").alias("a"))
    )
    columns = query_columns.withColumn("column_name", F.lower("column_name")).distinct()
    located = (
        columns.join(by_name, ["question_id", "qualifier"], "left")
        .join(by_alias, ["question_id", "qualifier"], "left")
        .withColumn("table_name", F.coalesce("n", "a"))
    )
    known = located.filter("table_name is not null").select("question_id", "table_name", "column_name")
    open_columns = located.filter("table_name is null").select("question_id", "database_name", "column_name")
    used = query_tables.select("question_id", F.col("name").alias("table_name")).distinct()
    found = (
        open_columns.join(
            catalog.select("database_name", "table_name", "column_name").distinct(),
            ["database_name", "column_name"],
        )
        .join(used, ["question_id", "table_name"], "left_semi")
        .select("question_id", "table_name", "column_name")
    )
    return known.unionByName(found).distinct()
