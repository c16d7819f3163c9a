"""Prompt templates as columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark import constants as K


def template_text(kind: str, use_cot: bool, has_knowledge: bool, with_question: bool, open_select: bool) -> str:
    """The fixed text of one template variant; ``kind`` is ``sql`` or ``schema_linking``."""
    texts = K.PROMPT_TEXTS[kind]
    lines = [texts["schema"], ""]
    lines += [K.KNOWLEDGE_LINE, texts["with_knowledge"]] if has_knowledge else [texts["no_knowledge"]]
    if with_question:
        lines.append(texts["question"])
    tail = texts["cot"] if use_cot else ""
    return "\n".join(lines) + "\n" + tail + (K.SELECT_OPENER if open_select else "")


def prompt_template(
    kind: str,
    knowledge: Column,
    *,
    use_cot: bool = False,
    use_knowledge: bool = True,
    with_question: bool = True,
    open_select: bool | None = None,
) -> Column:
    """Per row: the variant with the knowledge line where knowledge is present, else the one without."""
    select = (kind == "sql") if open_select is None else open_select
    plain = F.lit(template_text(kind, use_cot, False, with_question, select))
    if not use_knowledge:
        return plain
    informed = F.lit(template_text(kind, use_cot, True, with_question, select))
    return F.when(F.length(knowledge) > 0, informed).otherwise(plain)


def fill_prompt(template: Column, schema: Column, knowledge: Column, question: Column | None = None) -> Column:
    """Fill question, schema and knowledge, in that order (a later one also fills text of an earlier one)."""
    out = template
    if question is not None:
        out = F.replace(out, F.lit("{question}"), question)
    out = F.replace(out, F.lit("{database_schema}"), schema)
    return F.replace(out, F.lit("{knowledge}"), F.coalesce(knowledge, F.lit("")))


def template_inputs(df: DataFrame, template: Column, fields: Sequence[str], output: str = "input_mappings") -> DataFrame:
    """A map of just those fields whose ``{key}`` stands in the row's template."""
    pairs = []
    for name in fields:
        pairs += [F.lit(name), F.col(name).cast("string")]
    keys = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    mapping = F.map_filter(F.create_map(*pairs), lambda k, v: F.array_contains(keys, k))
    return df.withColumn(output, mapping)


def reasoning_request(sql: Column) -> Column:
    return F.replace(F.lit(K.STEP_REQUEST), F.lit("{sql_query}"), sql)
