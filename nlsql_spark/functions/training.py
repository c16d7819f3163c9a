"""Training-text, id and label columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nlsql_spark import constants as K


def context_text(prompt: Column, question: Column) -> Column:
    return F.concat(F.lit(K.CONTEXT + " "), prompt, F.lit(K.QUESTION + " "), question)


def answer_text(steps: Column, query: Column) -> Column:
    return F.concat(F.lit(K.REASONING + " "), F.array_join(steps, " "), F.lit(f" {K.SQL} "), query)


def training_text(prompt: Column, question: Column, steps: Column, query: Column) -> Column:
    reasoned = F.concat(context_text(prompt, question), F.lit("\n"), answer_text(steps, query))
    return F.when(question.isNotNull(), reasoned).otherwise(F.concat(prompt, F.lit(" "), query))


def evaluation_text(prompt: Column, question: Column) -> Column:
    reasoned = F.concat(context_text(prompt, question), F.lit(f"\n{K.REASONING} "))
    return F.when(question.isNotNull(), reasoned).otherwise(F.concat(prompt, F.lit(K.SELECT_OPENER)))


def instruction_pair(
    prompt: Column, question: Column, steps: Column | None = None, query: Column | None = None, mode: str = "train"
) -> tuple[Column, Column]:
    """(instruction, expected answer); in eval mode the answer is only its opening."""
    instruction = F.when(question.isNotNull(), context_text(prompt, question)).otherwise(prompt)
    if mode == "train":
        answer = F.when(question.isNotNull(), answer_text(steps, query)).otherwise(query)
    elif mode == "eval":
        answer = F.when(question.isNotNull(), F.lit(K.REASONING + " ")).otherwise(F.lit("SELECT "))
    else:
        raise ValueError(f"mode must be train or eval, not {mode}")
    return instruction, answer


def render_chat(messages: Column, add_generation_prompt: bool = False) -> Column:
    """``messages`` is an ordered ARRAY<STRUCT<role, content>>."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(K.TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(K.TURN_END + "\n")
        ),
    )
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(f"{K.TURN_START}assistant\n")) if add_generation_prompt else text


def chat_source(instruction: Column) -> Column:
    """One user turn followed by the assistant opener."""
    message = F.array(F.struct(F.lit("user").alias("role"), instruction.alias("content")))
    return render_chat(message, add_generation_prompt=True)


def chat_answer(answer: Column, mode: str = "train") -> Column:
    return F.concat(answer, F.lit("\n" + K.TURN_END)) if mode == "train" else answer


def add_special_ids(ids: Column, bos: int, eos: int | None = None) -> Column:
    """BOS in front; EOS behind when given (train mode)."""
    parts = [F.array(F.lit(bos)), ids]
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def full_attention(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def mask_source_labels(ids: Column, source_len: Column) -> Column:
    n = F.least(F.greatest(F.coalesce(source_len, F.lit(0)), F.lit(0)), F.size(ids))
    return F.concat(F.array_repeat(F.lit(K.LABEL_MASK), n), F.slice(ids, n + 1, F.size(ids)))


def mask_padded_labels(ids: Column, attention: Column) -> Column:
    return F.zip_with(ids, attention, lambda x, a: F.when(a == 0, F.lit(K.LABEL_MASK)).otherwise(x))


def trim_input_ids(output_ids: Column, attention: Column) -> Column:
    """Drop as many leading ids as the input has attended positions."""
    attended = F.size(F.filter(attention, lambda a: a == 1))
    return F.slice(output_ids, attended + 1, F.greatest(F.size(output_ids), F.lit(1)))


def last_attended(vectors: Column, attention: Column) -> Column:
    """The vector at the last attended position."""
    attended = F.aggregate(attention, F.lit(0), lambda total, a: total + a.cast("int"))
    return F.get(vectors, attended - 1)


def pad_ids(ids: Column, width: Column, fill: int, side: str = "right") -> Column:
    gap = F.array_repeat(F.lit(fill), (width - F.size(ids)).cast("int"))
    if side == "right":
        return F.concat(ids, gap)
    if side == "left":
        return F.concat(gap, ids)
    raise ValueError(f"side must be left or right, not {side}")
