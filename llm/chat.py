"""Chat formatting with Spark expressions only: collected turns are sorted, adjacent turns of a role merged, and
all is concatenated with a mask of the texts a model should learn.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each merged turn; texts that were merged into one turn stand
between ``<|im_sep|>``. Inside roles and texts every ``<``, any number of backslashes, ``|`` gets one more backslash,
so no control string can arise and the change can be undone; a line end in a role becomes ``<|nl|>``.

The output has one row per conversation: ``pieces`` (text, learn) in order. Their concatenation is the formatted
text; pieces with ``learn`` are the loss mask (the assistants' texts, without marks).

Turns are collected per conversation after a partial collection in each map task. A conversation is one value
of the result, so it must fit into a row.

Defined results: a null text is empty, a null role is the empty role; equal turn numbers stand in the order of
role and text, a null turn number first; a null conversation id is a conversation of its own; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, END, SEP, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def format_chats(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: the id, ``n_merged`` and ``pieces`` array<struct<text, learn>>."""
    role = F.regexp_replace(escape(F.coalesce(F.col(role_col), F.lit(""))), "\n", LINE)
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), escape(text).alias("text"))
    sorted_turns = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # the first turn of each run of one role, then a sentinel behind the last turn
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    runs = sorted_turns.withColumn("starts", F.concat(starts, F.array(F.size("turns"))))
    merged = F.transform(
        F.slice("starts", 1, F.size("starts") - 1),
        lambda at, k: F.struct(
            F.get("turns", at)["role"].alias("role"),
            F.transform(F.slice("turns", at + 1, F.get("starts", k + 1) - at), lambda t: t["text"]).alias("texts"),
        ),
    )
    piece = lambda t, learn: F.struct(t.alias("text"), learn.alias("learn"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda m: F.concat(
                F.array(piece(F.concat(F.lit(START), m["role"], F.lit("\n")), no)),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.concat(
                            F.when(i > 0, F.array(piece(F.lit(SEP), no))).otherwise(F.slice(F.array(piece(F.lit(SEP), no)), 1, 0)),
                            F.array(piece(t, m["role"] == LEARNED_ROLE)),
                        ),
                    )
                ),
                F.array(piece(F.lit(END + "\n"), no)),
            ),
        )
    )
    return runs.withColumn("merged", merged).select(id_col, F.size("merged").cast("long").alias("n_merged"), pieces.alias("pieces"))


def formatted_text(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["learn"]), lambda p: unescape(p["text"])), "")


def parse_text(text: Column) -> Column:
    """array<struct<role, texts>> of the merged turns of a formatted text, with the escapes undone."""
    blocks = F.split(text, r"\Q" + END + r"\E\n")
    inner = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.substr(b, F.lit(len(START) + 1)))
    return F.transform(
        inner,
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
            F.transform(
                F.split(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), r"\Q" + SEP + r"\E", -1), unescape
            ).alias("texts"),
        ),
    )


def turn_lines(turns: Column) -> Column:
    """role, line end, text, line end of each turn, in one string."""
    return F.array_join(
        F.flatten(F.transform(turns, lambda m: F.transform(m["texts"], lambda t: F.concat(m["role"], F.lit("\n"), t, F.lit("\n"))))),
        "",
    )
