"""Schema linking: which (table, column) pairs a question is about.

Links come out as ``schema_links ARRAY<STRUCT<table_name, columns ARRAY<STRING>>>``, one row a question.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark.functions.binding import let
from nlsql_spark.functions.text import link_tokens, name_in
from nlsql_spark.operators.catalog import nest_catalog
from nlsql_spark.operators.name_index import LINK, name_links
from nlsql_spark.session import broadcast_if_small, is_small

LINKS_TYPE = "array<struct<table_name:string,columns:array<string>>>"
#: Questions whose links a task holds at once.
HELD_ROWS = 1_000
#: Columns of the tables that words name, over the questions that a task compares at once; a single question may have more.
MOST_COLUMNS = 4_000_000
EMPTY_LINK = "array(named_struct('table_name', '', 'columns', cast(array() as array<string>)))"


def join_catalog(
    questions: DataFrame, catalog: DataFrame, how: str = "inner", keys: DataFrame | None = None, examples: DataFrame | None = None
) -> DataFrame:
    """Questions with their database's nested schema in ``tables``.

    ``how='inner'`` drops questions of unknown databases, ``how='required'`` fails on them. The nested
    schemas are broadcast only if the catalogue is small; beyond that it is a shuffle join that AQE
    splits on hot databases. ``examples`` (database_name, table_name, row_no, values) adds sample rows to the tables.
    """
    nested = broadcast_if_small(nest_catalog(catalog, keys, examples), measure=catalog)
    if how == "required":
        joined = questions.join(nested, "database_name", "left")
        missing = F.raise_error(F.concat(F.lit("no catalogue for database "), F.col("database_name")))
        return joined.withColumn("tables", F.when(F.col("tables").isNotNull(), F.col("tables")).otherwise(missing))
    return questions.join(nested, "database_name", how)


def substring_links(sql: Column, tables: Column, word_boundary: bool = False) -> Column:
    """Links of one query text against its database's nested tables.

    Columns are only tested for tables whose name occurs; tables without a column hit are left out. The nested
    tables hold their names in lower case.
    """

    def links(text: Column) -> Column:
        hit = lambda name, key: name_in(name, text, True) if word_boundary else F.contains(text, key)
        named = F.filter(tables, lambda t: hit(t["table_name"], t["key"]))
        matched = F.transform(
            named,
            lambda t: F.struct(
                t["table_name"].alias("table_name"),
                F.array_sort(
                    F.transform(F.filter(t["columns"], lambda c: hit(c["column_name"], c["key"])), lambda c: c["column_name"])
                ).alias("columns"),
            ),
        )
        return F.filter(matched, lambda link: F.size(link["columns"]) > 0)

    # bound to a name: the lambdas would lower the text again for every table and column
    return let(sql if word_boundary else F.lower(sql), links)


def link_by_substring(questions: DataFrame, catalog: DataFrame, word_boundary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ground-truth links: table and column name both occur in the query text. A question of an unknown database fails.

    All names of a database are found in one pass over the text (``name_index``). ``keep``: columns of the questions to keep.
    """
    return name_links(questions, catalog, "sql_query", word_boundary, keep)


def mentioned_columns(questions: DataFrame, catalog: DataFrame, sql_col: str = "sql_query") -> DataFrame:
    """``question_id, table_name, column_name`` of all pairs that are ``mentioned`` in the query text, one row a catalogue row.

    A text meets the columns of those tables only whose name occurs in it, and is lowered once, not once per pair.
    Questions of unknown databases have no row.
    """
    on = ["database_name", "table_name"]
    names = catalog.select(*on, "column_name", F.lower("column_name").alias("__column"))
    tables = catalog.select(*on).distinct().withColumn("__table", F.lower("table_name"))
    asked = questions.select("question_id", "database_name", F.lower(sql_col).alias("__text"))
    named = asked.join(broadcast_if_small(tables, measure=catalog), "database_name").filter(F.contains("__text", "__table"))
    pairs = named.join(broadcast_if_small(names, measure=catalog), on).filter(F.contains("__text", "__column"))
    return pairs.select("question_id", "table_name", "column_name")


def entity_tokens(catalog: DataFrame, min_len: int = 3) -> DataFrame:
    """Distinct (database, token, table, column) with a NULL column for table-name tokens."""
    tables = catalog.select("database_name", "table_name", F.lit(None).cast("string").alias("column_name"))
    names = tables.distinct().unionByName(catalog.select("database_name", "table_name", "column_name"))
    entity = F.coalesce("column_name", "table_name")
    return names.select(
        "database_name", "table_name", "column_name",
        F.explode(F.array_distinct(link_tokens(entity, min_len))).alias("token"),
    )


def similar_tokens(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(database, left token, right token) with edit distance <= ``distance``, over distinct tokens.

    A word cut into ``distance + 1`` pieces keeps one piece unchanged under ``distance`` edits, moved by
    at most ``distance`` places. So both sides meet in an equi-join on (database, word length, piece
    number, piece), and only those candidates are measured: exact, without comparing all pairs. A right word
    of at most ``distance`` letters has no such pieces; see ``similar_short_tokens``.
    """
    a = left.select("database_name", F.col("token").alias("left_token")).distinct()
    b = right.select("database_name", F.col("token").alias("right_token")).distinct()
    if distance == 0:
        return a.select("database_name", "left_token", F.col("left_token").alias("right_token")).join(
            b, ["database_name", "right_token"], "left_semi"
        ).select("database_name", "left_token", "right_token")

    pieces = distance + 1
    short = similar_short_tokens(a, b.filter(F.length("right_token") <= distance), distance)
    b = b.filter(F.length("right_token") > distance)
    n = F.length("right_token")
    cut_start = lambda i, size: F.floor(i * size / pieces).cast("int")
    cut_len = lambda i, size: cut_start(i + 1, size) - cut_start(i, size)
    kept = b.select(
        "database_name", "right_token", n.alias("len"), F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("piece")
    ).withColumn(
        "text",
        F.substr("right_token", cut_start(F.col("piece"), F.col("len")) + 1, cut_len(F.col("piece"), F.col("len"))),
    )
    size = F.length("left_token")
    probe = (
        a.withColumn("len", F.explode(F.sequence(F.greatest(size - distance, F.lit(1)), size + distance)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(distance))))
        .withColumn("at", cut_start(F.col("piece"), F.col("len")))
        .withColumn("n", cut_len(F.col("piece"), F.col("len")))
        .withColumn("shift", F.explode(F.sequence(F.lit(-distance), F.lit(distance))))
        .filter("at + shift >= 0 and at + shift + n <= length(left_token)")
        .withColumn("text", F.substr("left_token", F.col("at") + F.col("shift") + 1, F.col("n")))
        .select("database_name", "left_token", "len", "piece", "text")
        .distinct()
    )
    close = F.levenshtein("left_token", "right_token", distance) >= 0
    near = probe.join(kept, ["database_name", "len", "piece", "text"]).filter(close)
    return near.select("database_name", "left_token", "right_token").distinct().unionByName(short)


def shortened(word: Column, least: Column) -> Column:
    """The distinct words left of a (short) word when letters are taken out and at least ``least`` stay, never none."""
    letters = F.split(word, "")
    has = lambda mask, i: F.floor(mask / F.pow(F.lit(2), i)) % 2 == 1
    left = lambda mask: F.array_join(F.filter(letters, lambda _, i: has(mask, i)), "")
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.length(word)).cast("int") - 1)
    return F.array_distinct(F.transform(F.filter(masks, lambda m: F.bit_count(m) >= least), left))


def similar_short_tokens(a: DataFrame, short: DataFrame, distance: int) -> DataFrame:
    """The pairs whose right word has at most ``distance`` letters.

    Words within ``distance`` edits become equal when up to ``distance`` letters are taken out of each. A left word longer
    than ``distance`` keeps a letter then, so both sides meet in an equi-join on what is left, and no key is empty.
    Two words of at most ``distance`` letters are always near: each pair of them is a row of the result.
    """
    long = a.filter((F.length("left_token") > distance) & (F.length("left_token") <= 2 * distance))
    size = F.length("left_token")
    probe = long.withColumn("key", F.explode(shortened(F.col("left_token"), size - distance)))
    kept = short.withColumn("key", F.explode(shortened(F.col("right_token"), F.lit(1))))
    close = F.levenshtein("left_token", "right_token", distance) >= 0
    near = probe.join(kept, ["database_name", "key"]).filter(close).select("database_name", "left_token", "right_token").distinct()
    both = a.filter((F.length("left_token") <= distance) & (F.length("left_token") > 0)).join(short.filter("right_token <> ''"), "database_name")
    return near.unionByName(both.select("database_name", "left_token", "right_token"))


def link_by_tokens(
    questions: DataFrame,
    catalog: DataFrame,
    edit_distance: int = 0,
    min_len: int = 3,
    use_knowledge: bool = False,
    keep: tuple[str, ...] = (),
    single_ids: bool = False,
) -> DataFrame:
    """Links by common words: the matched columns of a table, or all of them if only its name matches.

    Questions without any link get one empty link. Words meet in equi-joins on (database, word); the
    matches are regrouped once, by question. ``keep``: columns of the questions to keep. ``single_ids``: the caller
    knows that no id is NULL or comes twice, so over a small catalogue no question is moved.
    """
    text = F.concat_ws(" ", "question", F.coalesce("knowledge", F.lit(""))) if use_knowledge else F.col("question")
    words = questions.select(
        "question_id", "database_name", F.explode(F.array_distinct(link_tokens(text, min_len))).alias("token")
    )
    entities = entity_tokens(catalog, min_len)
    if edit_distance > 0:
        pairs = similar_tokens(words, entities, edit_distance)
        targets = (
            entities.withColumnRenamed("token", "right_token")
            .join(pairs, ["database_name", "right_token"])
            .select("database_name", F.col("left_token").alias("token"), "table_name", "column_name")
            .distinct()
        )
    else:
        targets = entities
    on = ["database_name", "table_name"]
    ordered = F.array_sort(F.collect_list(F.struct("column_pos", "column_name")))
    tables = catalog.groupBy(*on).agg(F.min("table_pos").alias("table_pos"), ordered["column_name"].alias("all_columns"))
    # joined to the questions' tables at the end: a small catalogue goes to them, a large one is shuffled
    names = broadcast_if_small(tables, measure=catalog)
    # one row per (word, table): places of the columns the word names, none if it names the table only
    named = (
        targets.groupBy(*on, "token")
        .agg(F.collect_set("column_name").alias("names"))
        .join(tables, on)
    )
    places = F.filter(
        F.transform("all_columns", lambda c, i: F.when(F.array_contains("names", c), i)), lambda i: i.isNotNull()
    )
    named = named.select(*on, "token", places.alias("places"))
    if edit_distance == 0 and is_small(catalog):
        # a few words per catalogue row, so the catalogue's size bounds it; near words have no such bound
        given, tokens = ("question_id", "question", *keep), F.array_distinct(link_tokens(text, min_len))
        if single_ids:
            return held_links(questions.select(*given, F.col("database_name").alias("__db"), tokens.alias("__tokens")), tables, named, given)
        asked = questions.select("question_id", "database_name", tokens.alias("tokens"))
        return held_links(questions.select(*given).join(texts_by_id(asked), "question_id", "left"), tables, named, given)
    # only places travel; a question's matches are at most its database's schema. Partitioned by
    # question once, which serves both groupings and the last join
    hits = words.join(named, ["database_name", "token"]).drop("token").repartition("question_id")
    per_table = hits.groupBy("question_id", *on).agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    named_columns = F.transform(F.array_sort("places"), lambda i: F.get("all_columns", i))
    columns = F.when(F.size("places") > 0, named_columns).otherwise(F.col("all_columns"))
    linked = (
        per_table.join(names, on)
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("table_pos", "table_name", columns.alias("columns")))).alias("tables"))
    )
    links = F.transform("tables", lambda t: F.struct(t["table_name"].alias("table_name"), t["columns"].alias("columns")))
    return questions.join(linked, "question_id", "left").select(
        "question_id", "question", *keep, F.coalesce(links, F.expr(EMPTY_LINK)).alias("schema_links")
    )


def texts_by_id(asked: DataFrame) -> DataFrame:
    """``question_id, __texts``: database and words of all rows of an id, where there are any.

    No database or no word has no link, and NULL ids meet no question.
    """
    texts = asked.filter("question_id is not null and database_name is not null and size(tokens) > 0")
    return texts.groupBy("question_id").agg(F.collect_list(F.struct("database_name", "tokens")).alias("__texts"))


def ranges(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``ends[i]`` up to ``ends[i + 1]`` for each ``i`` of ``which``, one range after the other, and their sizes."""
    sizes = ends[which + 1] - ends[which]
    upto = np.cumsum(sizes)
    return np.arange(sizes.sum()) + np.repeat(ends[which] - upto + sizes, sizes), sizes


def distinct(x: np.ndarray) -> np.ndarray:
    """In order; ``np.unique`` would hash the numbers, which takes several times as long."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def held_links(questions: DataFrame, tables: DataFrame, named: DataFrame, given: tuple[str, ...]) -> DataFrame:
    """``link_by_tokens`` where every task holds the words of a (small) catalogue: neither a match nor a link is shuffled.

    ``questions``: the columns ``given``, and ``__texts`` (see ``texts_by_id``; rows of one id count as one question) or else
    ``__db`` and ``__tokens`` of the row; ``tables``: table_pos and all_columns of each table; ``named``: the places
    of the columns that a word names in a table.
    """
    first = lambda x: (x is not None, x if x is not None else "")
    place = lambda r: ((r["table_pos"] is not None, r["table_pos"] or 0), first(r["table_name"]))
    held = sorted(tables.collect(), key=place)  # in the order of links
    number = {(r["database_name"], r["table_name"]): i for i, r in enumerate(held)}
    at = [0, *accumulate(len(r["all_columns"]) for r in held)]
    names = [c for r in held for c in r["all_columns"]]
    # what links are taken from; the last table, of no column, is that of the empty link
    all_tables, all_columns = pa.array([*(r["table_name"] for r in held), ""], pa.string()), pa.array(names, pa.string())
    begin, width, most = np.array([*at, at[-1]]), len(held) + 1, max(len(names), 1)
    table_of = np.repeat(np.arange(len(held)), np.diff(at))
    index: dict[tuple[str, str], int] = {}
    hits: list[tuple[list[int], list[int]]] = []
    for r in named.collect():
        table, word = number[r["database_name"], r["table_name"]], index.setdefault((r["database_name"], r["token"]), len(hits))
        if word == len(hits):
            hits.append(([], []))
        hits[word][0].append(table)
        hits[word][1].extend(at[table] + i for i in r["places"])
    word_tables, word_columns = (
        (np.array([0, *accumulate(len(h[k]) for h in hits)]), np.array([i for h in hits for i in h[k]], np.int64)) for k in (0, 1)
    )
    reach = np.array([sum(at[i + 1] - at[i] for i in of) for of, _ in hits], np.int64)
    grouped = "__texts" in questions.columns

    def links(rows: list[list[tuple[str | None, list[str] | None]]]) -> pa.Array:
        found = [(i, index[db, token]) for i, texts in enumerate(rows) for db, tokens in texts for token in tokens or () if (db, token) in index]
        row, word = np.array(found, np.int64).reshape(-1, 2).T
        if len(rows) > 1 and reach[word].sum() > MOST_COLUMNS:
            return pa.concat_arrays([links(rows[: len(rows) // 2]), links(rows[len(rows) // 2 :])])

        def met(ends: np.ndarray, numbers: np.ndarray, base: int) -> np.ndarray:
            """The distinct tables (or columns) that words of a row name, row by row."""
            places, sizes = ranges(ends, word)
            return distinct(np.repeat(row, sizes) * base + numbers[places])

        columns, tables = met(*word_columns, most), met(*word_tables, width)
        empty = np.setdiff1d(np.arange(len(rows)), tables // width)
        tables = np.sort(np.concatenate([tables, empty * width + width - 1]))
        their = columns // most * width + table_of[columns % most] if len(columns) else columns
        sizes = np.searchsorted(their, tables, "right") - np.searchsorted(their, tables)
        whole = sizes == 0  # named by itself only: all its columns
        every, every_size = ranges(begin, tables[whole] % width)
        sizes[whole] = every_size
        places, of_whole = np.empty(sizes.sum(), np.int64), np.repeat(whole, sizes)
        places[of_whole], places[~of_whole] = every, columns % most
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        of_row = ends(np.bincount(tables // width, minlength=len(rows)))
        lists = pa.ListArray.from_arrays(ends(sizes), all_columns.take(pa.array(places)))
        flat = pa.StructArray.from_arrays([all_tables.take(pa.array(tables % width)), lists], fields=list(LINK))
        if any(len(texts) > 1 for texts in rows):
            # tables of several databases may be at one place
            order = list(range(len(tables)))
            for i, texts in enumerate(rows):
                if len(texts) > 1 and i not in empty:
                    a, b = of_row[i].as_py(), of_row[i + 1].as_py()
                    order[a:b] = sorted(order[a:b], key=lambda x: (place(held[tables[x] % width]), [first(c) for c in lists[x].as_py()]))
            flat = flat.take(pa.array(order, pa.int32()))
        return pa.ListArray.from_arrays(of_row, flat)

    def texts_of(part: pa.RecordBatch) -> list[list[tuple]]:
        if not grouped:
            return [[one] for one in zip(part.column("__db").to_pylist(), part.column("__tokens").to_pylist())]
        return [[(x["database_name"], x["tokens"]) for x in texts or ()] for texts in part.column("__texts").to_pylist()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), HELD_ROWS):
                part = batch.slice(at, HELD_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in given), links(texts_of(part))], [*given, "schema_links"])

    types = [f"{f.name} {f.dataType.simpleString()}" for f in questions.select(*given).schema]
    return questions.mapInArrow(scan, ", ".join([*types, f"schema_links {LINKS_TYPE}"]))


def group_pairs(pairs: Column) -> Column:
    """An ordered ARRAY<STRUCT<table_name, column_name>> to links, tables by first appearance."""
    tables = F.array_distinct(F.transform(pairs, lambda p: p["table_name"]))
    columns = lambda t: F.transform(
        F.filter(pairs, lambda p: p["table_name"] == t), lambda p: p["column_name"]
    )
    return F.transform(tables, lambda t: F.struct(t.alias("table_name"), columns(t).alias("columns")))


def pairs_to_links(df: DataFrame, pairs: str = "pairs", output: str = "schema_links") -> DataFrame:
    """Chosen pairs to links; each pair counts once. No pairs (or NULL) give no links."""
    links = group_pairs(F.array_sort(F.array_distinct(pairs)))
    return df.withColumn(output, F.coalesce(links, F.array().cast(LINKS_TYPE)))


def links_flat(links: DataFrame, col: str = "schema_links") -> DataFrame:
    """One row per (question, table, column).

    The outer forms keep Spark from adding a size filter that would evaluate the links twice.
    """
    per_table = links.select("question_id", F.inline_outer(col))
    flat = per_table.select("question_id", "table_name", F.explode_outer("columns").alias("column_name"))
    return flat.filter("column_name is not null")


def link_by_embedding(neighbours: DataFrame, documents: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """k nearest documents to links, columns in document order.

    ``neighbours``: query_id, doc_id, distance, rank (see ``knn``). ``documents``: document_id,
    table_name, col_name. ``questions`` (example_id, input_to_embed) adds the embedded text.
    """
    found = neighbours.join(broadcast_if_small(documents), neighbours["doc_id"] == documents["document_id"])
    # a group is the k neighbours of one question
    grouped = found.groupBy(F.col("query_id").alias("question_id")).agg(
        F.array_sort(
            F.collect_list(F.struct("document_id", "table_name", F.col("col_name").alias("column_name")))
        ).alias("pairs")
    )
    if questions is not None:
        texts = questions.select(F.col("example_id").alias("question_id"), F.col("input_to_embed").alias("question"))
        grouped = grouped.join(texts, "question_id", "left")
    kept = [c for c in ("question_id", "question") if c in grouped.columns]
    return grouped.select(*kept, group_pairs(F.col("pairs")).alias("schema_links"))
