"""Training tables: vocabulary, ids, masks, padded batches."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions import training as T
from nlsql_spark.functions.text import strip
from nlsql_spark.operators.ordering import ordered_position
from nlsql_spark.session import materialize


# vocabulary rows (a word and a number) and bytes of words up to which it is sent to every task
BROADCAST_WORDS = 1_000_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Blank-separated words; special tokens stand alone even where they touch a word."""
    specials = "|".join("\\Q" + token + "\\E" for token in K.SPECIAL_TOKENS)
    # the class of first characters is tested before the tokens are tried one by one
    firsts = "".join(sorted({"\\" + token[0] for token in K.SPECIAL_TOKENS}))
    bracketed = F.contains(text, F.lit("[")) | F.contains(text, F.lit("<"))
    spaced = F.when(bracketed, F.regexp_replace(text, f"(?=[{firsts}])({specials})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(strip(spaced), r"\s+"), "")


def build_vocab(df: DataFrame, text: str = "text", min_count: int = 1, **numbering) -> DataFrame:
    """``token, id``: the special tokens, then the words by falling count (ties: alphabetical).

    The counts are materialised: the texts are read once, and encoding reads the small table.
    """
    counts = (
        df.select(F.explode(words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") >= min_count) & ~F.col("token").isin(K.SPECIAL_TOKENS))
        .withColumn("rank", -F.col("n"))
    )
    ranked = ordered_position(materialize(counts), ["rank", "token"], name="id", **numbering).select(
        "token", (F.col("id") + len(K.SPECIAL_TOKENS)).cast("int").alias("id")
    )
    fixed = [(token, i) for i, token in enumerate(K.SPECIAL_TOKENS)]
    return df.sparkSession.createDataFrame(fixed, "token string, id int").unionByName(ranked)


def encode(
    df: DataFrame,
    vocab: DataFrame,
    key: list[str],
    text: str = "text",
    output: str = "ids",
    broadcast_words: int = BROADCAST_WORDS,
    listed: str | None = None,
) -> DataFrame:
    """Replace each text by its word ids (unknown words: ``<unk>``). ``listed`` names a column of its words, if it is cut already.

    A vocabulary of up to ``broadcast_words`` goes to every task, which looks the words up in Arrow
    batches: no word is shuffled. A larger one is joined on the word (AQE splits hot words), and
    (key, position, id) is regrouped by text.
    """
    unknown = K.SPECIAL_TOKENS.index(K.UNK)
    none = F.array().cast("array<string>")
    tokens_of = F.coalesce(F.col(listed), none) if listed else words(F.coalesce(F.col(text), F.lit("")))
    size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    if size[0] <= broadcast_words and size[1] <= BROADCAST_BYTES:
        head = vocab.select("token", "id").toArrow().combine_chunks()
        table = df.sparkSession.sparkContext.broadcast((head.column("token").combine_chunks(), head.column("id").to_numpy()))

        @F.arrow_udf("array<int>")
        def look_up(texts: pa.Array) -> pa.Array:
            """Each distinct word of a batch is looked up once."""
            tokens, ids = table.value
            coded = texts.flatten().dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=tokens.cast(coded.dictionary.type))
            known = np.where(np.asarray(place.is_valid()), ids[place.fill_null(0).to_numpy()], unknown).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(texts)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(known[coded.indices.to_numpy()]))

        return df.withColumn(output, look_up(tokens_of))

    # rows are told apart by their place in a stored table: keys may repeat
    df = materialize(df.withColumn("__row", F.monotonically_increasing_id()))
    placed = df.select("__row", F.posexplode(tokens_of).alias("pos", "token"))
    found = placed.join(vocab, "token", "left").select(
        "__row", F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")).alias("t")
    )
    ids = found.groupBy("__row").agg(F.array_sort(F.collect_list("t"))["id"].alias(output))
    no_ids = F.array().cast("array<int>")
    return df.join(ids, "__row", "left").withColumn(output, F.coalesce(F.col(output), no_ids)).drop("__row")


def tokenized_dataset(samples: DataFrame, vocab: DataFrame, kind: str, mode: str = "train", key: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Ids, attention and labels of ``pretraining``, ``instruction`` or ``probe`` samples.

    Samples have prompt, question, reasoning_steps, query; probe samples have ``text`` and ``label``.
    """
    bos, eos = K.SPECIAL_TOKENS.index(K.BOS), K.SPECIAL_TOKENS.index(K.EOS)
    keys = list(key)
    c = F.col
    if kind == "pretraining":
        text = (
            T.training_text(c("prompt"), c("question"), c("reasoning_steps"), c("query"))
            if mode == "train"
            else T.evaluation_text(c("prompt"), c("question"))
        )
        coded = encode(samples.select(*keys, text.alias("text")), vocab, keys)
        ids = T.add_special_ids(c("ids"), bos, eos if mode == "train" else None)
        return coded.select(*keys, ids.alias("input_ids")).withColumn("attention_mask", T.full_attention(c("input_ids")))
    if kind == "probe":
        coded = encode(samples.select(*keys, "text", "label"), vocab, keys)
        return coded.select(*keys, T.add_special_ids(c("ids"), bos).alias("input_ids"), "label").withColumn(
            "attention_mask", T.full_attention(c("input_ids"))
        )
    if kind != "instruction":
        raise ValueError(f"unknown dataset kind: {kind}")
    instruction, answer = T.instruction_pair(c("prompt"), c("question"), c("reasoning_steps"), c("query"), mode)
    source, target = T.chat_source(instruction), T.chat_answer(answer, mode)
    if mode == "eval":
        coded = encode(samples.select(*keys, F.concat(source, target).alias("text")), vocab, keys)
        return coded.select(*keys, c("ids").alias("input_ids")).withColumn("attention_mask", T.full_attention(c("input_ids")))
    # the source ends in a line break, so both parts are cut on their own; a word is an id, so the source
    # part is as long as its word list
    cut = samples.select(*keys, words(source).alias("__source"), words(target).alias("__target"))
    sized = cut.select(*keys, F.concat("__source", "__target").alias("words"), F.size("__source").alias("source_len"))
    coded = encode(sized, vocab, keys, listed="words")
    return coded.select(
        *keys,
        c("ids").alias("input_ids"),
        T.full_attention(c("ids")).alias("attention_mask"),
        T.mask_source_labels(c("ids"), c("source_len")).alias("target_ids"),
    )


def pad_batches(
    df: DataFrame,
    order: list[str],
    batch_size: int,
    multiple: int = 8,
    side: str = "right",
    pad_id: int = 0,
    labels: str | None = None,
    drop_last: bool = False,
    **numbering,
) -> DataFrame:
    """Batches of ``batch_size`` rows in order, each padded to its longest row, rounded up to a multiple.

    Labels are the ids (or the ``labels`` column, padded alike) with the mask value at padded places.
    A window group is one batch.
    """
    placed = ordered_position(df, order, name="__pos", **numbering)
    placed = placed.withColumn("batch", F.floor(F.col("__pos") / batch_size).cast("long")).drop("__pos")
    batch = Window.partitionBy("batch")
    longest = F.max(F.size("input_ids")).over(batch)
    placed = placed.withColumns(
        {"__width": (F.ceil(longest / multiple) * multiple).cast("int"), "__rows": F.count("*").over(batch)}
    )
    if drop_last:
        placed = placed.filter(F.col("__rows") == batch_size)
    width = F.col("__width")
    given = F.col("input_ids") if labels is None else F.col(labels)
    return placed.withColumn("__labels", T.pad_ids(given, width, pad_id, side)).withColumns(
        {
            "input_ids": T.pad_ids(F.col("input_ids"), width, pad_id, side),
            "attention_mask": T.pad_ids(F.col("attention_mask"), width, 0, side),
        }
    ).withColumn("labels", T.mask_padded_labels(F.col("__labels"), F.col("attention_mask"))).drop(
        "__width", "__rows", "__labels"
    )
