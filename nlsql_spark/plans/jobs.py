"""The user-level jobs: each a composition of operators from tables to a table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions.prompts import fill_prompt, prompt_template
from nlsql_spark.functions.text import clean_sql, map_difficulty, question_text, rescue_sql
from nlsql_spark.operators.confidence import confidence_per_sequence, marker_confidence
from nlsql_spark.operators.execution import execution_match
from nlsql_spark.operators.knn import knn
from nlsql_spark.operators.link_metrics import nested_link_metrics
from nlsql_spark.operators.linking import link_by_embedding, link_by_substring, link_by_tokens
from nlsql_spark.operators.model_steps import EmbedFn, GenerateFn, echo, embed, generate
from nlsql_spark.operators.ordering import union_all
from nlsql_spark.operators.probe import binary_report, probe_contexts, score_probe, train_probe
from nlsql_spark.operators.profile import build_documents, column_profiles, document_texts, first_values
from nlsql_spark.operators.retry import train_val_split
from nlsql_spark.operators.schema_text import apply_links, render_ddl
from nlsql_spark.operators.scoring import execution_accuracy, pair_results, valid_efficiency_score
from nlsql_spark.operators.training_tables import build_vocab, pad_batches, tokenized_dataset
from nlsql_spark.session import broadcast_if_small, is_small, materialize


def retrieval_documents(
    catalog: DataFrame,
    descriptions: DataFrame,
    tables: dict[str, tuple[DataFrame, dict[str, str], str]],
    database_name: str,
    **exclusions: bool,
) -> DataFrame:
    """Documents to embed for every column of one database.

    ``tables``: name -> (data, formats by column, column that orders the rows).
    """
    profiles = union_all([column_profiles(df, database_name, name, formats, order) for name, (df, formats, order) in tables.items()])
    first = None
    if exclusions.get("uuid_keys"):
        firsts = union_all([first_values(df, database_name, name, order) for name, (df, _, order) in tables.items()])
        profiles = firsts.join(profiles, ["database_name", "table_name", "column_name"], "left")
        first = F.col("first_value")
    documents = build_documents(catalog, descriptions, profiles)
    return document_texts(documents, values_text=F.coalesce("values_text", F.lit("")), first_value=first, **exclusions)


def vector_links(
    questions: DataFrame, documents: DataFrame, texts: DataFrame, k: int, fn: EmbedFn | None = None, **options
) -> DataFrame:
    """Links of the ``k`` columns nearest to each question.

    ``documents``: document_id, table_name, col_name; ``texts``: example_id, input_to_embed.
    """
    asked = questions.select(
        F.col("question_id").alias("example_id"), question_text(F.col("question"), F.col("knowledge")).alias("input_to_embed")
    )
    # the search reads its sides more than once: the model runs once, into stored vectors
    asked_vectors = materialize(embed(asked, fn, is_query=True, **options))
    near = knn(asked_vectors, materialize(embed(texts, fn, **options)), k)
    return link_by_embedding(near, documents, asked)


def schema_prompts(
    questions: DataFrame,
    links: DataFrame,
    catalog: DataFrame,
    keys: DataFrame | None = None,
    kind: str = "sql",
    repair: bool = True,
    examples: DataFrame | None = None,
    **template,
) -> DataFrame:
    """``question_id, prompt`` with the schema of the repaired links, or the whole schema without links.

    ``examples`` (database_name, table_name, row_no, values) are sample rows to show with the tables.
    """
    with_schema = apply_links(questions, links, catalog, keys, repair, render_ddl(catalog, keys, examples), examples)
    knowledge = F.col("knowledge")
    prompt = fill_prompt(prompt_template(kind, knowledge, **template), F.col("database_schema"), knowledge, F.col("question"))
    return with_schema.select("question_id", prompt.alias("prompt"))


def training_batches(
    samples: DataFrame,
    kind: str = "pretraining",
    mode: str = "train",
    key: tuple[str, ...] = ("question_id",),
    text: Column | None = None,
    batch_size: int = 8,
    multiple: int = 8,
    side: str = "right",
) -> DataFrame:
    """Vocabulary, ids and padded batches of a sample table."""
    corpus = F.concat_ws(" ", "prompt", "question", F.array_join("reasoning_steps", " "), "query") if text is None else text
    vocab = build_vocab(samples.select(corpus.alias("text")))
    # numbering the rows takes a second pass: over stored ids, not over the texts
    ids = materialize(tokenized_dataset(samples, vocab, kind, mode, key))
    labels = "target_ids" if kind == "instruction" and mode == "train" else None
    return pad_batches(ids, list(key), batch_size, multiple, side, K.SPECIAL_TOKENS.index(K.PAD), labels)


def probe_report(samples: DataFrame, fn: EmbedFn | None = None, ratio: float = 0.8, dim: int = 64, seed: int = 0) -> DataFrame:
    """Labelled contexts, their vectors, a probe on the training part, its report on the rest."""
    contexts = probe_contexts(samples).select(
        F.xxhash64("question_id", "item").alias("example_id"), F.col("text").alias("input_to_embed"), "question_id", "item", "label"
    )
    # read by the split, by every training pass and by the report: built and embedded once, each label beside its vector
    stored = materialize(embed(contexts, fn, dim=dim, seed=seed, keep=("question_id", "item", "label")))
    data = stored.select("example_id", "embedding", "label")
    # rows of one id count as one example: each of its vectors meets each of its labels
    repeated = stored.filter("item = 0").groupBy("question_id").count().filter("count > 1")
    if not repeated.isEmpty():
        data = materialize(data.drop("label").join(data.select("example_id", "label"), "example_id"))
    split = train_val_split(data, "example_id", ratio, seed)
    model = train_probe(split.filter("is_train"), maxIter=20)
    return binary_report(score_probe(model, split.filter("not is_train")))


def generate_sql(
    prompts: DataFrame, fn: GenerateFn = echo, *, cleanup: Callable[[Column], Column] = clean_sql, **options
) -> DataFrame:
    """``question_id, sql, error``: model replies, queries rescued from error texts, cleaned."""
    asked = prompts.select(F.col("question_id").alias("id"), "prompt")
    replies = generate(asked, fn, **options)
    return replies.select(
        F.col("id").alias("question_id"), cleanup(rescue_sql(F.col("response"), F.col("error"))).alias("sql"), "error"
    )


def execution_report(
    spark: SparkSession, truth: DataFrame, predictions: DataFrame, timings: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame | None]:
    """Execution accuracy by difficulty and, with timings, the efficiency score.

    ``truth``: question_id, difficulty, sql; ``predictions``: question_id, sql, pos. Missing = wrong.
    """
    levels = truth.withColumn("difficulty", map_difficulty(F.col("difficulty")))
    paired = pair_results(levels.withColumnRenamed("sql", "truth_sql"), predictions)
    run = paired.filter("not missing").select("question_id", "truth_sql", F.col("predicted_sql"))
    matches = execution_match(spark, run, **options)
    every = paired.select("question_id").join(matches, "question_id", "left")
    every = every.select("question_id", F.coalesce("matched", F.lit(False)).alias("matched"))
    ves = None if timings is None else valid_efficiency_score(timings, every)
    return execution_accuracy(every, levels), ves


def link_report(questions: DataFrame, catalog: DataFrame, edit_distance: int = 0) -> DataFrame:
    """Token links scored against ground-truth links.

    Token links are many times larger than the questions. Over a small catalogue both kinds of links are made beside each other
    in the row of the question, so no link is moved; rows without database, and rows whose id is NULL or comes twice, are joined.
    """
    both_sides = lambda some: (link_by_tokens(some, catalog, edit_distance), link_by_substring(some, catalog))
    if edit_distance > 0 or not is_small(catalog):
        return nested_link_metrics(*both_sides(questions))
    # NULL ids are a group of their own here
    groups = questions.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("n"), F.bool_or(F.isnull("database_name")).alias("open"))
    ids = groups.filter("id is null or n > 1 or open").select("id")
    single, others = questions, []
    if not ids.isEmpty():
        known = broadcast_if_small(materialize(ids))
        same = F.col("question_id").eqNullSafe(F.col("id"))
        single, others = questions.join(known, same, "left_anti"), [both_sides(questions.join(known, same, "left_semi"))]
    truth = link_by_substring(single, catalog, keep=("database_name",)).withColumnRenamed("schema_links", "true_links")
    return nested_link_metrics(link_by_tokens(truth, catalog, keep=("true_links",), single_ids=True), "true_links", *others)


def marker_report(tokens: DataFrame, is_marker: Column, **options) -> DataFrame:
    """Per sequence: the (before, after) confidence around each marker, in order."""
    return confidence_per_sequence(marker_confidence(tokens, is_marker, **options))
