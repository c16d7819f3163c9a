"""Name resolution over nested queries: sub-queries, derived tables and common table expressions.

Tables of one query (any number of scopes a question):

    scopes    question_id, scope_id, parent_id        parent_id is NULL for the outermost scope
    bindings  question_id, database_name, scope_id, name, alias, inner_scope
              a table of the catalogue, or (``inner_scope``) the result of another scope, under a name and an alias ('' if none)
    outputs   question_id, scope_id, output_name, qualifier, column_name
              what a scope gives to the scope around it
    columns   question_id, scope_id, qualifier, column_name        the columns a scope uses; qualifier '' if none

A name is looked up in its scope and then outwards. If it is found in a derived table, the search goes on in the scope behind it, with
the name the column has there, until a table of the catalogue is reached.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlsql_spark.session import broadcast_if_small, materialize

#: Scopes that one name may lead through.
MOST_STEPS = 200


def bound_names(bindings: DataFrame, outputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per binding: its qualifiers, the catalogue's names of its table (``owners``), what its scope gives (``given``).

    Columns of a table are not listed: a name is looked up among them when a search meets the binding.
    """
    names = F.array_distinct(F.array(F.lower("name"), F.lower(F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias")).otherwise(F.col("name")))))
    bound = bindings.select(
        "question_id", F.col("scope_id").alias("at"), "database_name", "name", F.lower("name").alias("table_key"), names.alias("qualifiers"), "inner_scope"
    ).distinct()
    known = catalog.groupBy("database_name", F.lower("table_name").alias("table_key")).agg(F.collect_set("table_name").alias("owners"))
    base = bound.filter("inner_scope is null").join(broadcast_if_small(known), ["database_name", "table_key"], "left")
    # a group is the select list of one scope
    given = outputs.groupBy("question_id", F.col("scope_id").alias("inner_scope")).agg(
        F.collect_set(F.struct(F.lower("output_name").alias("key"), F.lower("qualifier").alias("q"), F.lower("column_name").alias("c"))).alias("given")
    )
    derived = bound.filter("inner_scope is not null").join(given, ["question_id", "inner_scope"], "left")
    owners = F.coalesce("owners", F.array_compact(F.array("name")))
    return base.withColumn("owners", owners).unionByName(derived, allowMissingColumns=True)


def resolve_scoped_columns(scopes: DataFrame, bindings: DataFrame, outputs: DataFrame, columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """``question_id, scope_id, qualifier, column_name, table_name, source_column``: the catalogue column behind each column used.

    A qualified name belongs to the nearest scope that has the qualifier, even if the catalogue does not know the column; a bare one
    to the nearest scope in which a table has such a column (all of them, if there are several). Names that no scope knows have no row.
    Every round moves all open names by one scope; there are as many rounds as the longest way of a name, not rows.
    """
    bound = materialize(bound_names(bindings, outputs, catalog))
    around = materialize(scopes.select("question_id", "scope_id", "parent_id"))
    tables = materialize(
        catalog.groupBy("database_name", F.lower("table_name").alias("table_key"), F.lower("column_name").alias("c")).agg(F.collect_set("table_name").alias("tables"))
    )
    tables = broadcast_if_small(tables)
    origin = ["question_id", "scope_id", "qualifier", "column_name"]
    name = [*origin, "at", "q", "c"]
    open_names = columns.select(*origin).distinct().select(
        *origin, F.col("scope_id").alias("at"), F.lower("qualifier").alias("q"), F.lower("column_name").alias("c")
    )
    fits = F.coalesce(F.array_contains("qualifiers", F.col("q")), F.lit(False))
    # without a qualifier a column is known by its name alone
    meant = fits | F.coalesce(F.col("q") == "", F.lit(False))
    steps = F.transform(
        F.filter("given", lambda g: g["key"] == F.col("c")), lambda g: F.struct(F.col("inner_scope").cast("int").alias("at"), g["q"].alias("q"), g["c"].alias("c"))
    )
    every = lambda found: F.array_distinct(F.flatten(F.collect_list(found)))
    found: list[DataFrame] = []
    for _ in range(MOST_STEPS):
        met = open_names.join(bound, ["question_id", "at"], "left").join(tables, ["database_name", "table_key", "c"], "left")
        # a group is the bindings of one scope
        met = materialize(
            met.groupBy(*name).agg(
                F.bool_or(fits).alias("has"), every(F.when(fits, F.col("owners"))).alias("owners"),
                every(F.when(meant & F.col("inner_scope").isNull(), F.col("tables"))).alias("tables"), every(F.when(meant, steps)).alias("steps"),
            )
        )
        if met.isEmpty():
            break
        known = (F.size("tables") > 0) | (F.size("steps") > 0)
        # the qualifier is known, the column is not: the table is named all the same
        ends = F.when(known, F.col("tables")).when(F.col("has"), F.col("owners"))
        found.append(met.select(*origin, F.explode(ends).alias("table_name"), F.col("c").alias("source_column")))
        inwards = met.select(*origin, F.inline("steps"))
        outwards = (
            met.filter(~known & ~F.col("has"))
            .select(*origin, F.col("at").alias("inner"), "q", "c")
            .join(around.select("question_id", F.col("scope_id").alias("inner"), F.col("parent_id").alias("at")), ["question_id", "inner"])
            .filter("at is not null")
        )
        open_names = inwards.unionByName(outwards.select(inwards.columns)).distinct()
    else:
        raise ValueError(f"a name leads through more than {MOST_STEPS} scopes")
    if not found:
        empty = "question_id long, scope_id int, qualifier string, column_name string, table_name string, source_column string"
        return columns.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found).distinct()
