"""Text columns: normalising, tokens, question / document text, SQL clean-up."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions.binding import let


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(K.WHITESPACE))


def normalize_identifier(c: Column) -> Column:
    return F.lower(F.translate(strip(c), '"`', ""))


def normalize_text(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_record(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trim and lower every field (or the named ones)."""
    return df.withColumns({name: normalize_text(F.col(name)) for name in (cols or df.columns)})


def normalize_link_text(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"(?U)[^a-z0-9\s]", "")


def link_tokens(c: Column, min_len: int = 3, stop_words: Sequence[str] = K.STOP_WORDS) -> Column:
    """Words of at least ``min_len`` characters that are no stop words."""
    cuts = "|".join(rf"{word[:at]}(?={word[at:]}\b)" for word, at in K.SPLIT_WORDS.items())
    text = F.regexp_replace(normalize_link_text(c), rf"\b({cuts})", "$1 ")
    keep = lambda word: (F.length(word) >= min_len) & ~word.isin(list(stop_words))
    return F.filter(F.split(text, r"(?U)\s+"), keep)


def question_text(question: Column, knowledge: Column | None = None) -> Column:
    parts = [normalize_text(question)]
    if knowledge is not None:
        parts.append(normalize_text(F.coalesce(knowledge, F.lit(""))))
    return F.concat_ws(" ", *parts)


def serialize_values(values: Column) -> Column:
    return normalize_text(F.array_join(values, " ", "None"))


def is_known_format(c: Column) -> Column:
    return c.isin(K.KNOWN_FORMATS)


def drop_null_items(values: Column) -> Column:
    return F.array_compact(values)


def representative_values(values: Column, data_format: Column, k: int = K.TOP_VALUES) -> Column:
    """``min max`` for numbers and dates, the ``k`` most frequent texts (ties: first seen), else ''.

    ``values`` is the value list of one column record, already in the format's own type order:
    numeric formats compare as numbers, dates as text.
    """

    def number_span(present: Column) -> Column:
        numbers = F.transform(present, lambda v: F.struct(v.try_cast("double").alias("n"), v.alias("v")))
        return let(numbers, lambda xs: F.concat_ws(" ", F.array_min(xs)["v"], F.array_max(xs)["v"]))

    def text_span(present: Column) -> Column:
        return F.concat_ws(" ", F.array_min(present), F.array_max(present))

    def top(present: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                F.array_distinct(present),
                lambda v: F.struct(
                    (-F.size(F.filter(present, lambda x: x == v))).alias("n"),
                    F.array_position(present, v).alias("pos"),
                    v.alias("v"),
                ),
            )
        )
        return serialize_values(F.transform(F.slice(ranked, 1, k), lambda r: r["v"]))

    def pick(present: Column) -> Column:
        return (
            F.when(~is_known_format(data_format) | (F.size(present) == 0), F.lit(""))
            .when(data_format == "text", top(present))
            .when(data_format.isin("integer", "real"), number_span(present))
            .otherwise(text_span(present))
        )

    return let(drop_null_items(values), pick)


def excluded_column(
    is_key: Column,
    data_format: Column,
    column_name: Column,
    first_value: Column,
    *,
    all_keys: bool = False,
    numeric_keys: bool = False,
    uuid_keys: bool = False,
    id_in_name: bool = False,
) -> Column:
    """The rules that keep a column out of the document set."""
    rules = [F.lit(False)]
    if all_keys:
        rules.append(is_key)
    if numeric_keys:
        rules.append(is_key & F.coalesce(data_format.isin(K.RANGE_FORMATS), F.lit(False)))
    if uuid_keys:
        rules.append(is_key & F.coalesce(first_value.rlike(K.UUID_PATTERN), F.lit(False)))
    if id_in_name:
        rules.append(F.contains(F.lower(column_name), F.lit("id")))
    hit = rules[0]
    for rule in rules[1:]:
        hit = hit | rule
    return hit


def document_text(
    table_name: Column,
    column_name: Column,
    description: Column | None = None,
    data_format: Column | None = None,
    values_text: Column | None = None,
    excluded: Column | None = None,
) -> Column:
    """Table, column and the optional parts, one blank apart (kept even before an empty part; a NULL part is empty)."""
    parts = [normalize_text(table_name), normalize_text(column_name)]
    parts += [F.coalesce(normalize_text(part), F.lit("")) for part in (description, data_format) if part is not None]
    if values_text is not None:
        parts.append(F.coalesce(values_text, F.lit("")))
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(" "), part)
    return joined if excluded is None else F.when(~excluded, joined)


def prefix_query(c: Column, is_query: Column | bool = True, prefix: str = K.QUERY_PREFIX) -> Column:
    flag = F.lit(is_query) if isinstance(is_query, bool) else is_query
    return F.when(flag, F.concat(F.lit(prefix), c)).otherwise(c)


def mentioned(table_name: Column, column_name: Column, sql: Column, word_boundary: bool = False) -> Column:
    """Both names occur in the query text, ignoring case."""
    return name_in(table_name, sql, word_boundary) & name_in(column_name, sql, word_boundary)


def name_in(name: Column, sql: Column, word_boundary: bool = False) -> Column:
    if word_boundary:
        pattern = F.concat(F.lit(r"(?i)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))
        return F.regexp_like(sql, pattern)
    return F.contains(F.lower(sql), F.lower(name))


def tokens_match(a: Column, b: Column, distance: int = 0) -> Column:
    return a == b if distance == 0 else F.levenshtein(a, b, distance) >= 0


def any_token_match(xs: Column, ys: Column, distance: int = 0) -> Column:
    if distance == 0:
        return F.arrays_overlap(xs, ys)
    return F.exists(xs, lambda x: F.exists(ys, lambda y: tokens_match(x, y, distance)))


def clean_sql(
    c: Column,
    question: Column | None = None,
    *,
    add_select: bool = False,
    normalize: bool = True,
    with_reasoning: bool = False,
    end_token: str = K.EOS,
) -> Column:
    """Clean a generated query; with ``question`` the text after the question is kept."""
    out = F.concat(F.lit("SELECT "), c) if add_select else c
    if normalize:
        out = F.translate(out, "\t\n", "  ")
        for old, new in (('\\"', '"'), ("``", "`"), (end_token, ""), (K.TURN_END, "")):
            out = F.replace(out, F.lit(old), F.lit(new))
    if with_reasoning:
        out = strip(F.substring_index(out, K.SQL, -1))
    if question is not None:
        out = second_part(out, question)
    return strip(out)


def second_part(c: Column, separator: Column) -> Column:
    """What lies between the first and the second occurrence of a literal separator (NULL if none)."""
    rest = F.substr(c, F.position(separator, c) + F.length(separator))
    stop = F.position(separator, rest)
    cut = F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(F.contains(c, separator), cut)


def rescue_sql(response: Column, error: Column) -> Column:
    """Take the query out of a reply parser's error text; otherwise keep the response."""
    found = F.regexp_extract(error, r'(?s)\{\s*"sql":\s*"(.*?)"\s*\}', 1)
    has_match = F.regexp_like(error, F.lit(r'(?s)\{\s*"sql":\s*"(.*?)"\s*\}'))
    return F.when(
        error.isNotNull() & (error != "") & (error != "None") & has_match,
        strip(F.translate(found, "\n", " ")),
    ).otherwise(response)


def split_steps(c: Column) -> Column:
    """Reply text to a step list, runs of newlines count as one; NULL gives no steps."""
    steps = F.split(F.regexp_replace(c, "\n+", "\n"), "\n")
    return F.coalesce(steps, F.array().cast("array<string>"))


def mask_keys(c: Column, keys: Sequence[str]) -> Column:
    """Hide the values of sensitive map keys."""
    return F.transform_values(c, lambda k, v: F.when(k.isin(list(keys)), F.lit("***")).otherwise(v))


def map_difficulty(c: Column, strict: bool = True) -> Column:
    level = F.lit(None).cast("string")
    for name, label in K.DIFFICULTY_LEVELS.items():
        level = F.when(c == name, F.lit(label)).otherwise(level)
    if not strict:
        return level
    problem = F.raise_error(F.concat(F.lit("unknown difficulty: "), F.coalesce(c, F.lit("NULL"))))
    return F.when(c.isin(list(K.DIFFICULTY_LEVELS)), level).otherwise(problem)
