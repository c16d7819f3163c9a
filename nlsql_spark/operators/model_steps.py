"""Batch model steps: user callables run inside tasks over Arrow batches."""

import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions.text import prefix_query
from nlsql_spark.functions.vectors import hash_vector, l2_normalize
from nlsql_spark.session import broadcast_if_small, materialize
from nlsql_spark.sources.task_files import read_folder, write_whole

GenerateFn = Callable[[list[str]], list[str]]
EmbedFn = Callable[[list[str]], list[list[float]]]
#: Rows of request batches that a task collects.
TASK_ROWS = 100_000
#: Bytes of vectors that a task holds before it gives them back.
VECTOR_BYTES = 1 << 20


def echo(prompts: list[str]) -> list[str]:
    """The default text model: replies with the last line of the prompt."""
    return [prompt.rsplit("\n", 1)[-1] for prompt in prompts]


def batch_by_template(df: DataFrame, template: str = "prompt_template", key: str = "id", batch_size: int = 1_000) -> DataFrame:
    """Request batches of one template: ``template, batch, ids, inputs``.

    A template's rows are spread over hash batches of about ``batch_size``, so a template that most rows
    share is never one group.
    """
    # one row per template, stored: where there are few, no row is sent to its template
    known = df.filter(F.col(template).isNotNull())
    sizes = materialize(known.groupBy(template).agg(F.greatest(F.ceil(F.count("*") / batch_size), F.lit(1)).alias("__n")))
    placed = df.join(broadcast_if_small(sizes), template).withColumn("batch", F.pmod(F.xxhash64(key), F.col("__n")).cast("long"))
    # a task holds the batches it collects, so there are more tasks where there are more batches
    batches = sizes.agg(F.sum("__n")).first()[0] or 0
    tasks = math.ceil(batches * batch_size / TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed = placed.repartition(tasks, template, "batch")
    entry = F.struct(F.col(key), F.col("input_mappings"))
    rows = placed.groupBy(template, "batch").agg(F.collect_list(entry).alias("r"))
    return rows.select(template, "batch", F.col(f"r.{key}").alias("ids"), F.col("r.input_mappings").alias("inputs"))


def generate(
    df: DataFrame,
    fn: GenerateFn = echo,
    *,
    id_col: str = "id",
    prompt_col: str = "prompt",
    batch_size: int = 32,
    max_retries: int = 2,
    concurrency: int | None = None,
    backoff_s: float = 0.5,
    ledger: str | None = None,
) -> DataFrame:
    """``id, response, error`` from a text model. ``concurrency`` bounds the tasks that call it at once.

    A batch that keeps failing is retried row by row, so one bad prompt does not cost its neighbours. With a ``ledger``
    (a folder all executors reach) every reply is kept under its id and the digest of its prompt as soon as it is there:
    neither a repeated task nor a later run asks for it again. Errors are not kept.
    """
    if ledger is not None:
        return _generate_with_ledger(
            df, fn, ledger, id_col=id_col, prompt_col=prompt_col, batch_size=batch_size, max_retries=max_retries,
            concurrency=concurrency, backoff_s=backoff_s,
        )

    ask = _asking(fn, max_retries, backoff_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                replies, errors = zip(*ask(part[prompt_col].tolist()))
                yield pd.DataFrame({id_col: part[id_col].tolist(), "response": list(replies), "error": list(errors)})

    narrow = df.select(id_col, prompt_col)
    if concurrency is not None:
        narrow = narrow.repartition(concurrency)
    id_type = df.schema[id_col].dataType.simpleString()
    return narrow.mapInPandas(run, f"{id_col} {id_type}, response string, error string")


LEDGER = "id string, digest string, response string"


def ledger_replies(spark: SparkSession, ledger: str) -> DataFrame:
    """``id, digest, response`` of all replies in the ledger, each once."""
    from nlsql_spark.sources.files import path_exists

    if not path_exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    kept = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    return kept.groupBy("id", "digest").agg(F.min("response").alias("response"))


def _generate_with_ledger(df: DataFrame, fn: GenerateFn, ledger: str, *, id_col: str, prompt_col: str, **options) -> DataFrame:
    """Known replies from the ledger; the rest from tasks that write each batch of replies before they go on.

    A task looks first for what earlier attempts at its partition have written, in a folder of this call and partition.
    """
    run = f"{ledger}/run-{uuid.uuid4().hex}"
    asked = df.select(id_col, prompt_col, F.md5(F.coalesce(prompt_col, F.lit(""))).alias("digest"), F.col(id_col).cast("string").alias("__id"))
    known = ledger_replies(df.sparkSession, ledger).select(F.col("id").alias("__id"), "digest", "response")
    done = asked.join(known, ["__id", "digest"]).select(id_col, "response", F.lit(None).cast("string").alias("error"))
    todo = asked.join(known, ["__id", "digest"], "left_anti")
    if options["concurrency"] is not None:
        todo = todo.repartition(options["concurrency"])
    step = options["batch_size"]
    ask = _asking(fn, options["max_retries"], options["backoff_s"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = f"{run}/part-{TaskContext.get().partitionId()}"
        replies = {(i, d): r for t in read_folder(folder) for i, d, r in zip(*(t.column(c).to_pylist() for c in ("id", "digest", "response")))}
        for pdf in batches:
            missing = pdf[[k not in replies for k in zip(pdf["__id"], pdf["digest"])]]
            errors = {}
            for at in range(0, len(missing), step):
                part = missing.iloc[at : at + step]
                fresh = []
                for key, (reply, error) in zip(zip(part["__id"], part["digest"]), ask(part[prompt_col].tolist())):
                    if error is None:
                        replies[key] = reply
                        fresh.append((*key, reply))
                    else:
                        errors[key] = error
                if fresh:
                    columns = zip(*fresh)
                    write_whole(folder, pa.table({c: pa.array(v, pa.string()) for c, v in zip(("id", "digest", "response"), columns)}))
            keys = list(zip(pdf["__id"], pdf["digest"]))
            yield pd.DataFrame({id_col: pdf[id_col].tolist(), "response": [replies.get(k) for k in keys], "error": [errors.get(k) for k in keys]})

    id_type = df.schema[id_col].dataType.simpleString()
    return todo.mapInPandas(work, f"{id_col} {id_type}, response string, error string").unionByName(done)


def _asking(fn: GenerateFn, max_retries: int, backoff_s: float):
    """``prompts`` to (reply, error) pairs: a batch that keeps failing is asked row by row."""

    def attempt(prompts: list[str]) -> tuple[list[str] | None, str | None]:
        error = None
        for tries in range(max_retries + 1):
            try:
                replies = fn(prompts)
                if len(replies) != len(prompts):
                    raise ValueError("the model returned a different number of replies")
                return replies, None
            except Exception as problem:  # the model is user code: any failure becomes a row's error
                error = f"{type(problem).__name__}: {problem}"
                if tries < max_retries:
                    time.sleep(backoff_s * 2**tries)
        return None, error

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        replies, error = attempt(prompts)
        if replies is not None:
            return [(r, None) for r in replies]
        if len(prompts) == 1:
            return [(None, error)]
        return [pair for prompt in prompts for pair in ask([prompt])]

    return ask


def embed(
    df: DataFrame,
    fn: EmbedFn | None = None,
    *,
    is_query: bool = False,
    normalize: bool = True,
    dim: int = 128,
    batch_size: int = 64,
    seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``example_id, embedding`` of ``example_id, input_to_embed``; without a model, hash vectors.

    ``keep`` names further columns of the rows that stay beside their vector.
    """
    texts = df.select("example_id", *keep, prefix_query(F.col("input_to_embed"), is_query, K.QUERY_PREFIX).alias("text"))
    if fn is None:
        vectors = texts.select("example_id", *keep, hash_vector(F.col("text"), dim, seed).alias("embedding"))
    else:
        names = ["example_id", *keep]
        vector_type = pa.list_(pa.float64())

        def ask(asked: list[str]) -> pa.Array:
            plain = lambda v: v if v is None or isinstance(v, list) else np.asarray(v, dtype=np.float64)
            out = pa.array([plain(v) for v in fn(asked)], vector_type)
            if len(out) != len(asked):
                raise ValueError(f"the model returned {len(out)} vectors for {len(asked)} texts")
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = batch.column("text").to_pylist()
                at = 0
                # the model sees ``batch_size`` texts at once; rows go back in larger batches
                while at < len(asked):
                    first, held, done = at, 0, []
                    while at < len(asked) and held < VECTOR_BYTES:
                        done.append(ask(asked[at : at + batch_size]))
                        at, held = at + batch_size, held + done[-1].nbytes
                    vectors = pa.concat_arrays(done)
                    rows = batch.slice(first, len(vectors))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), vectors], [*names, "embedding"])

        fields = [texts.schema[c] for c in names]
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[1:])
        schema = f"example_id long, {types + ', ' if types else ''}embedding array<double>"
        vectors = texts.withColumn("example_id", F.col("example_id").cast("long")).mapInArrow(run, schema)
    vector = l2_normalize(F.col("embedding")) if normalize else F.col("embedding")
    return vectors.select("example_id", *keep, vector.cast("array<float>").alias("embedding"))


def hash_embed(df: DataFrame, dim: int = 128, seed: int = 0) -> DataFrame:
    """Random stand-in vectors, repeatable per text."""
    return df.select("example_id", hash_vector(F.col("input_to_embed"), dim, seed).cast("array<float>").alias("embedding"))


def pending(df: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    """Rows whose id is not materialised yet."""
    return df.join(done.select(key), key, "left_anti")


def embed_incremental(df: DataFrame, store: str, fn: EmbedFn | None = None, **options) -> DataFrame:
    """Embed what the keyed store lacks, each id once, add it as one commit, return the whole store."""
    from nlsql_spark.sources import keyed_store

    keyed_store.append(df, store, lambda todo: embed(todo, fn, **options))
    return keyed_store.read_store(df.sparkSession, store)
