"""Link repair and schema text (CREATE TABLE statements, sample rows), all in-row after one join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlsql_spark.functions.binding import let
from nlsql_spark.functions.draws import digest
from nlsql_spark.functions.text import normalize_identifier
from nlsql_spark.operators.catalog import nest_catalog
from nlsql_spark.operators.linking import LINKS_TYPE, join_catalog, pairs_to_links
from nlsql_spark.session import broadcast_if_small


def repair_links_column(links: Column, tables: Column) -> Column:
    """Normalise names, drop unknown tables and columns, widen empty links, add missing keys.

    ``tables`` is a database's nested schema (``nest_catalog``), which holds each table's names and key names.
    """
    normal = F.transform(
        links,
        lambda link: F.struct(
            normalize_identifier(link["table_name"]).alias("table_name"),
            F.transform(link["columns"], normalize_identifier).alias("columns"),
        ),
    )

    def mend(link: Column, table: Column) -> Column:
        real = F.filter(link["columns"], lambda c: F.array_contains(table["names"], c))
        full = lambda found: F.when(F.size(found) == 0, table["names"]).otherwise(
            F.concat(found, F.array_except(table["key_names"], found))
        )
        return F.struct(link["table_name"].alias("table_name"), let(real, full).alias("columns"))

    # unknown tables have no match and so leave nothing
    mended = F.transform(
        normal,
        lambda link: F.transform(
            F.filter(tables, lambda t: t["table_name"] == link["table_name"]), lambda t: mend(link, t)
        ),
    )
    return F.coalesce(F.flatten(mended), F.array().cast(LINKS_TYPE))


def repair_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """``links`` carries question_id, database_name and schema_links."""
    joined = join_catalog(links, catalog, "required")
    return joined.withColumn("schema_links", repair_links_column(F.col("schema_links"), F.col("tables"))).drop("tables")


def link_from_pairs(responses: DataFrame, catalog: DataFrame) -> DataFrame:
    """A model's chosen pairs (``pairs ARRAY<STRUCT<table_name, column_name>>``) to repaired links."""
    return repair_links(pairs_to_links(responses), catalog).select("question_id", "question", "schema_links")


def last_per_table(links: Column) -> Column:
    """One link per table, in order of first mention; the last mention's columns count."""
    names = F.array_distinct(F.transform(links, lambda link: link["table_name"]))
    last = lambda n: F.element_at(F.filter(links, lambda link: link["table_name"] == n), -1)
    return F.transform(names, lambda n: F.struct(n.alias("table_name"), last(n)["columns"].alias("columns")))


def union_per_table(links: Column) -> Column:
    """One link per table with the columns of all its mentions."""
    names = F.array_distinct(F.transform(links, lambda link: link["table_name"]))
    every = lambda n: F.array_distinct(
        F.flatten(F.transform(F.filter(links, lambda link: link["table_name"] == n), lambda link: link["columns"]))
    )
    return F.transform(names, lambda n: F.struct(n.alias("table_name"), every(n).alias("columns")))


def shuffle_columns(columns: Column, seed: int, salt: Column) -> Column:
    """A repeatable shuffle: columns in order of a hash of their name."""
    keyed = F.transform(
        columns,
        lambda c: F.struct(digest(F.lit(seed), salt, c["column_name"]).alias("h"), c["column_name"].alias("n"), c.alias("c")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def sample_rows_text(names: Column, rows: Column) -> Column:
    """Right-justified text table of a header and a few rows (ARRAY<ARRAY<STRING>>), NULL shown as None."""
    shown = F.transform(rows, lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit("None"))))
    lines = F.concat(F.array(names), shown)
    widths = F.transform(
        names,
        lambda n, i: F.array_max(F.transform(lines, lambda line: F.length(F.get(line, i)))),
    )
    render = lambda line: F.array_join(
        F.zip_with(line, widths, lambda v, w: F.concat(F.lpad(v, w, F.lit(" ")), F.lit(" "))), ""
    )
    return F.array_join(F.transform(lines, render), "\n")


def _table_text(t: Column, wanted: Column, shuffle_seed: int | None, all_constraints: bool) -> Column:
    # few names are looked up in a wide table; names that repeat in it need a pass over its columns
    places = F.filter(F.transform(wanted, lambda name: F.array_position(t["names"], name)), lambda p: p > 0)
    looked_up = F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.get(t["columns"], (p - 1).cast("int")))
    passed = F.filter(t["columns"], lambda c: F.array_contains(wanted, c["column_name"]))
    chosen = F.when(F.size(wanted) > 0, F.when(t["distinct_names"], looked_up).otherwise(passed)).otherwise(t["columns"])
    if shuffle_seed is not None:
        chosen = shuffle_columns(chosen, shuffle_seed, t["table_name"])
    return let(chosen, lambda columns: _statement(t, columns, wanted, all_constraints))


def _statement(t: Column, columns: Column, wanted: Column, all_constraints: bool) -> Column:
    covered = lambda names: F.size(F.array_except(names, wanted)) == 0
    if all_constraints:
        covered_by_filter, covered = covered, lambda names: (F.size(wanted) == 0) | covered_by_filter(names)
    fk_lines = F.transform(F.filter(t["fks"], lambda fk: covered(fk["local"])), lambda fk: fk["line"])
    pk_line = F.when((F.size(t["pk"]) > 1) & covered(t["pk"]), F.array(t["pk_line"])).otherwise(
        F.array().cast("array<string>")
    )
    column_lines = F.transform(columns, lambda c: c["line"])
    body = F.array_join(F.concat(column_lines, fk_lines, pk_line), ",\n")
    create = F.concat(F.lit("CREATE TABLE `"), t["table_name"], F.lit("`\n(\n"), body, F.lit("\n);"))

    places = F.transform(columns, lambda c: F.array_position(F.transform(t["columns"], lambda x: x["column_pos"]), c["column_pos"]))
    cells = F.transform(t["examples"], lambda r: F.transform(places, lambda p: F.get(r, (p - 1).cast("int"))))
    count = F.size(t["examples"]).cast("string")
    verbose = F.concat(
        F.lit("/* \n "), count, F.lit(" example rows: \n SELECT * FROM "), t["table_name"], F.lit(" LIMIT "), count,
        F.lit("; \n "), sample_rows_text(F.transform(columns, lambda c: c["column_name"]), cells), F.lit(" \n */"),
    )
    return F.when(F.size(t["examples"]) > 0, F.concat(create, F.lit(" \n "), verbose)).otherwise(create)


def ddl_text(
    tables: Column,
    links: Column | None = None,
    *,
    shuffle_seed: int | None = None,
    all_constraints: bool = False,
    union_links: bool = False,
) -> Column:
    """CREATE TABLE text of the linked tables (no links: of all tables), a blank line apart.

    Key constraints are printed only if the column filter names all their columns, so an unfiltered
    table shows none; ``all_constraints`` prints them there too.
    """
    text = lambda t, wanted: _table_text(t, wanted, shuffle_seed, all_constraints)
    no_filter = F.array().cast("array<string>")
    full = F.array_join(F.transform(tables, lambda t: text(t, no_filter)), "\n\n")
    if links is None:
        return full
    chosen = union_per_table(links) if union_links else last_per_table(links)
    # unknown tables have no match and so leave nothing
    texts = F.transform(
        chosen,
        lambda link: F.transform(
            F.filter(tables, lambda t: t["table_name"] == link["table_name"]), lambda t: text(t, link["columns"])
        ),
    )
    linked = F.array_join(F.flatten(texts), "\n\n")
    return F.when(F.coalesce(F.size(links), F.lit(0)) > 0, linked).otherwise(full)


def render_ddl(catalog: DataFrame, keys: DataFrame | None = None, examples: DataFrame | None = None, **options) -> DataFrame:
    """The full schema text, once per database."""
    nested = nest_catalog(catalog, keys, examples)
    return nested.select("database_name", ddl_text(F.col("tables"), **options).alias("database_schema"))


def apply_links(
    questions: DataFrame,
    links: DataFrame,
    catalog: DataFrame,
    keys: DataFrame | None = None,
    repair: bool = True,
    full_schema: DataFrame | None = None,
    examples: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Replace each question's schema text by that of its links; without links the old text stays.

    ``questions``: question_id, database_name, database_schema, ...; ``links``: question_id, schema_links.
    With ``full_schema`` (database_name, database_schema; see ``render_ddl``) the old text comes from
    there: it is long, so it joins after the questions have met their links and is never shuffled.
    ``examples`` (database_name, table_name, row_no, values; a few rows per table) are shown behind each table.
    """
    linked = questions.join(links.select("question_id", "schema_links"), "question_id", "left")
    joined = join_catalog(linked, catalog, "required", keys, examples)
    if full_schema is not None:
        joined = joined.join(broadcast_if_small(full_schema, measure=catalog), "database_name")
    chosen = F.coalesce("schema_links", F.array().cast(LINKS_TYPE))
    if repair:
        chosen = repair_links_column(chosen, F.col("tables"))
    joined = joined.withColumn("schema_links", chosen)
    text = F.when(
        F.size("schema_links") > 0, ddl_text(F.col("tables"), F.col("schema_links"), **options)
    ).otherwise(F.col("database_schema"))
    return joined.withColumn("database_schema", text).drop("tables")


def sample_rows(df: DataFrame, n: int, order_by: str | list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (of a given order, to be repeatable)."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def sample_rows_per_group(df: DataFrame, keys: list[str], order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each map output to ``n`` rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("row_no", F.row_number().over(window)).filter(F.col("row_no") <= n)
