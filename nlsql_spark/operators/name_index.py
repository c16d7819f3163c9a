"""All names of a database found in one pass over a text.

An Aho-Corasick automaton holds the table and column names of one database, so the work for a text grows with its length and its
hits, not with the number of columns. A task builds the automaton of a database when the first question of it comes.
"""

from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark.session import is_small

#: Questions of one database in one group, where the catalogue is too large to go to every task.
GROUP_QUESTIONS = 100_000
#: Automata that a task keeps.
MOST_INDEXES = 200
LINK = pa.struct([("table_name", pa.string()), ("columns", pa.list_(pa.string()))])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset(UPPER + LOWER + "0123456789_")


def folded(c: Column, word_boundary: bool) -> Column:
    """Lower case; for whole words of A-Z only, as their pattern has it."""
    return F.translate(c, UPPER, LOWER) if word_boundary else F.lower(c)


class NameIndex:
    """``columns``: (table place, table name, its key, column name, its key) of one database; keys are folded names."""

    def __init__(self, columns: list[tuple]):
        self.tables: dict[str, set] = {}
        self.columns: dict[str, list] = {}
        for place, table, table_key, column, column_key in columns:
            if table is not None:
                self.tables.setdefault(table_key, set()).add((place, table))
                if column is not None:
                    self.columns.setdefault(column_key, []).append(((place, table), column))
        self.automaton = ahocorasick.Automaton()
        for name in {*self.tables, *self.columns} - {""}:
            self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()

    def names_in(self, text: str, word_boundary: bool) -> set[str]:
        if not len(self.automaton):
            return {""}
        if not word_boundary:
            return {"", *(name for _, name in self.automaton.iter(text))}
        found, size = {""}, len(text)
        for end, name in self.automaton.iter(text):
            before, behind = end - len(name), end + 1
            if (before < 0 or text[before] not in WORD) and (behind >= size or text[behind] not in WORD):
                found.add(name)
        return found

    def links(self, text: str | None, word_boundary: bool) -> list[tuple[str, list[str]]]:
        """Named tables in their order, each with its named columns; tables without a named column are left out."""
        if text is None:
            return []
        names = self.names_in(text, word_boundary)
        tables = {t for name in names for t in self.tables.get(name, ())}
        found: dict[tuple, list[str]] = {}
        for name in names:
            for table, column in self.columns.get(name, ()):
                if table in tables:
                    found.setdefault(table, []).append(column)
        return [(table[1], sorted(found[table])) for table in sorted(found)]


def links_array(rows: list[list[tuple[str, list[str]]]]) -> pa.Array:
    """Link lists as one Arrow array, built from flat lists: no object is made per link."""
    links = [link for row in rows for link in row]
    ends = lambda lists: pa.array([0, *accumulate(map(len, lists))], pa.int32())
    columns = [columns for _, columns in links]
    flat = pa.ListArray.from_arrays(ends(columns), pa.array([c for some in columns for c in some], pa.string()))
    named = pa.StructArray.from_arrays([pa.array([table for table, _ in links], pa.string()), flat], fields=list(LINK))
    return pa.ListArray.from_arrays(ends(rows), named)


def name_links(
    questions: DataFrame, catalog: DataFrame, sql_col: str = "sql_query", word_boundary: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``question_id, question, schema_links`` by the names that occur in the query text, and the columns ``keep`` of the questions.

    A small catalogue (counted) goes to every task. A larger one meets the questions by database, the questions
    of a database in groups of bounded size. A question of a database without catalogue fails.
    """
    names = catalog.select(
        "database_name", "table_pos", "table_name", folded(F.col("table_name"), word_boundary).alias("table_key"), "column_name", folded(F.col("column_name"), word_boundary).alias("column_key")
    )
    asked = questions.select("question_id", "question", *keep, F.col("database_name").alias("__db"), folded(F.col(sql_col), word_boundary).alias("__text"))
    given = ["question_id", "question", *keep]
    types = [f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*given).schema]
    schema = ", ".join([*types, "schema_links array<struct<table_name:string,columns:array<string>>>"])

    def answers(batch: pa.RecordBatch, index_of) -> pa.RecordBatch:
        links = [index_of(db).links(text, word_boundary) for db, text in zip(batch.column("__db").to_pylist(), batch.column("__text").to_pylist())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), links_array(links)], [*given, "schema_links"])

    if is_small(catalog):
        held: dict[str, list[tuple]] = {}
        for row in names.collect():
            held.setdefault(row[0], []).append(tuple(row[1:]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built: dict[str, NameIndex] = {}

            def index_of(database: str) -> NameIndex:
                if database not in built:
                    if database not in held:
                        raise ValueError(f"no catalogue for database {database}")
                    if len(built) >= MOST_INDEXES:
                        built.clear()
                    built[database] = NameIndex(held[database])
                return built[database]

            for batch in batches:
                yield answers(batch, index_of)

        return asked.mapInArrow(scan, schema)

    sizes = asked.groupBy("__db").agg(F.ceil(F.count("*") / GROUP_QUESTIONS).cast("int").alias("__groups"))
    dealt = asked.join(sizes, "__db").withColumn("__part", F.pmod(F.xxhash64("question_id"), F.col("__groups")).cast("int")).drop("__groups")
    named = names.withColumnRenamed("database_name", "__db").join(sizes, "__db")
    spread = named.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1))).drop("__groups")

    def meet(key, asks: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asks):
            return pa.table({**{c: pa.array([], asks.schema.field(c).type) for c in given}, "schema_links": pa.array([], pa.list_(LINK))})
        if not len(known):
            raise ValueError(f"no catalogue for database {key[0].as_py()}")
        columns = ("table_pos", "table_name", "table_key", "column_name", "column_key")
        index = NameIndex(list(zip(*(known.column(c).to_pylist() for c in columns))))
        return pa.Table.from_batches([answers(b, lambda _: index) for b in asks.combine_chunks().to_batches()])

    on = ["__db", "__part"]
    return dealt.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(meet, schema)
