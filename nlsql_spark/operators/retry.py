"""Self-correction training data: wrong steps, each marked as taken back, in front of right ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions.binding import let
from nlsql_spark.functions.draws import digest, pick_except, uniform
from nlsql_spark.functions.prompts import fill_prompt, prompt_template
from nlsql_spark.functions.text import split_steps
from nlsql_spark.operators.linking import join_catalog, substring_links
from nlsql_spark.operators.schema_text import ddl_text
from nlsql_spark.session import deal_out

SINGLE, MULTIPLE = "single", "multiple"
FROM_FUTURE, FROM_PAST_AND_FUTURE = "from_future", "from_past_and_future"


def exclude_databases(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(~F.col("database_name").isin(list(names)))


def candidate_steps(steps: Column, index: Column, mode: str = FROM_FUTURE) -> Column:
    """The later steps, or all other steps, of the step at a 0-based index."""
    later = F.slice(steps, index + 2, F.greatest(F.size(steps), F.lit(1)))
    if mode == FROM_FUTURE:
        return later
    if mode == FROM_PAST_AND_FUTURE:
        return F.concat(F.slice(steps, F.lit(1), index), later)
    raise ValueError(f"unknown pool: {mode}")


def corrupt_steps_column(steps: Column, keys: list[Column], p: float, num: str, pool: str, seed: int) -> Column:
    """Before each step, with probability ``p``, another step of the pool plus the marker.

    ``num='multiple'`` repeats while a draw stays below ``p``: the run length is geometric, so one draw
    gives it. Draws are hashes of (seed, keys, step): the result does not depend on partitioning.
    """
    if num not in (SINGLE, MULTIPLE):
        raise ValueError(f"unknown number of corruptions: {num}")
    if not 0 <= p <= 1 or (num == MULTIPLE and p == 1):
        raise ValueError("p must be in [0, 1], below 1 for multiple corruptions")

    def one_step(step: Column, i: Column) -> Column:
        draw = uniform(F.lit(seed), *keys, i)
        if p == 0:
            count = F.lit(0)
        elif num == SINGLE:
            count = F.when(draw < p, F.lit(1)).otherwise(F.lit(0))
        else:
            count = F.floor(F.ln(draw) / F.ln(F.lit(p))).cast("int")
        later = F.size(steps) - i - 1
        size = later if pool == FROM_FUTURE else F.size(steps) - 1

        def wrong(j: Column) -> Column:
            at = F.floor(uniform(F.lit(seed), *keys, i, j) * size).cast("int")
            if pool == FROM_FUTURE:
                return F.concat(F.get(steps, at + i + 1), F.lit(K.BACK))
            other = let(at, lambda a: F.get(steps, F.when(a < i, a).otherwise(a + 1)))
            return F.concat(other, F.lit(K.BACK))

        # each draw is bound to a name: inside lambdas it would be hashed again wherever it is used
        runs = lambda n: F.concat(F.transform(F.sequence(F.lit(1), n), wrong), F.array(step))
        return let(count, lambda n: F.when((n > 0) & (size > 0), runs(n)).otherwise(F.array(step)))

    if pool not in (FROM_FUTURE, FROM_PAST_AND_FUTURE):
        raise ValueError(f"unknown pool: {pool}")
    return F.flatten(F.transform(steps, one_step))


def corrupt_steps(
    df: DataFrame, p: float, num: str = SINGLE, pool: str = FROM_FUTURE, seed: int = 0, keys: tuple[str, ...] = ("question_id",)
) -> DataFrame:
    """Corrupt ``reasoning_steps`` in place; one projection, no shuffle. A ``copy`` column joins the keys."""
    names = list(keys) + (["copy"] if "copy" in df.columns else [])
    column = corrupt_steps_column(F.col("reasoning_steps"), [F.col(n) for n in names], p, num, pool, seed)
    return df.withColumn("reasoning_steps", column)


def replicate(df: DataFrame, m: int) -> DataFrame:
    """``m`` copies of each sample, numbered from 1; the number is part of every draw's key."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(m))))


def attach_steps(entries: DataFrame, replies: DataFrame, on: str | list[str] = "question_id") -> DataFrame:
    """Add the steps of a model's reply (``reply``) to the entries, by id."""
    return entries.join(replies, on, "left").withColumn("reasoning_steps", split_steps(F.col("reply"))).drop("reply")


def attach_context(
    samples: DataFrame, links: DataFrame, catalog: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Training samples from given links: prompt with the linked schema, query, steps, question."""
    linked = samples.join(links.select("question_id", "schema_links"), "question_id")
    joined = join_catalog(linked, catalog, "required", keys)
    return _with_prompt(joined, ddl_text(F.col("tables"), F.col("schema_links")))


def _with_prompt(df: DataFrame, schema: Column) -> DataFrame:
    stepped = F.col("reasoning_steps").isNotNull()
    knowledge = F.col("knowledge")
    with_steps = fill_prompt(
        prompt_template("sql", knowledge, with_question=False, open_select=False), schema, knowledge
    )
    without = fill_prompt(
        prompt_template("sql", knowledge, with_question=True, open_select=False), schema, knowledge, F.col("question")
    )
    keep = ["question_id"] + (["copy"] if "copy" in df.columns else [])
    return df.select(
        *keep,
        F.when(stepped, with_steps).otherwise(without).alias("prompt"),
        F.col("sql_query").alias("query"),
        "reasoning_steps",
        F.when(stepped, F.col("question")).alias("question"),
    )


def build_retry_dataset(
    questions: DataFrame,
    catalog: DataFrame,
    keys: DataFrame | None = None,
    *,
    p: float = 0.2,
    copies: int = 1,
    num: str = SINGLE,
    pool: str = FROM_FUTURE,
    skip_databases: tuple[str, ...] = (),
    seed: int = 0,
) -> DataFrame:
    """The whole job: ground-truth links, linked schema prompt, copies, corrupted steps.

    One join with the catalogue serves the links and the schema text. The prompt is made before the
    copies, and everything after the join is projection: no shuffle. The questions are dealt to all cores before it.
    """
    kept = exclude_databases(questions, list(skip_databases)) if skip_databases else questions
    joined = join_catalog(deal_out(kept), catalog, "required", keys)
    # named columns, since the schema text uses the links, and the prompt the text, several times
    linked = joined.withColumn("__links", substring_links(F.col("sql_query"), F.col("tables")))
    schemas = linked.withColumn("__schema", ddl_text(F.col("tables"), F.col("__links")))
    samples = _with_prompt(schemas, F.col("__schema"))
    return corrupt_steps(replicate(samples, copies), p, num, pool, seed)


def perturb_identifiers(df: DataFrame, pools: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Swap each table / column name in ``sql_query`` with probability ``p`` for another of its kind.

    Words are compared with the database's names; text between words is kept as it is.
    """
    # one row per database: no larger than the databases' schemas; a question of an unknown database fails the job
    known = F.coalesce(F.col("tables"), F.raise_error(F.concat(F.lit("no names for database "), F.coalesce("database_name", F.lit("NULL")))))
    # once per database: whether its names are distinct, and the characters that names begin with
    once = lambda names: F.size(F.array_distinct(F.array_compact(names))) == F.size(names)
    heads = F.transform(F.concat("tables", "columns"), lambda name: F.substring(name, 1, 1))
    pools = pools.withColumns(
        {"__tables_once": once(F.col("tables")), "__columns_once": once(F.col("columns")), "__heads": F.array_join(F.array_distinct(heads), "")}
    )
    joined = df.join(pools, "database_name", "left").withColumn("tables", known)
    # quoted text is one piece, so a word inside a literal is never swapped
    pieces = F.regexp_extract_all("sql_query", F.lit(r"'(?:[^']|'')*'|\w+|[^\w']+|'"), F.lit(0))

    def swap(piece: Column, i: Column) -> Column:
        hit = uniform(F.lit(seed), F.col("question_id"), i) < p
        draw = uniform(F.lit(seed), F.col("question_id"), i, F.lit("pick"))

        def pick(names: str, otherwise: Column) -> Column:
            # a name that stands there once is stepped over; only repeated names need a pass over the pool
            def other(at: Column) -> Column:
                step = lambda i: F.get(F.col(names), F.when(i < at - 1, i).otherwise(i + 1))
                once = let(F.floor(draw * (F.size(names) - 1)).cast("int"), step)
                picked = F.when(F.col(f"__{names}_once"), once).otherwise(pick_except(F.col(names), piece, draw))
                return F.when(at > 0, F.coalesce(picked, piece)).otherwise(otherwise)

            return let(F.array_position(names, piece), other)

        # most pieces are blanks and key words, which begin like no name and need no draw
        may_be_name = F.contains("__heads", F.substring(piece, 1, 1))
        return F.when(F.coalesce(may_be_name, F.lit(True)) & hit, pick("tables", pick("columns", piece))).otherwise(piece)

    out = joined.withColumn("corrupted_query", F.array_join(F.transform(pieces, swap), ""))
    return out.drop("tables", "columns", "__tables_once", "__columns_once", "__heads")


def train_val_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """A shuffled split of exact size: ``is_train`` for ``int(n * ratio)`` rows.

    Rows are ordered by a hash of ``key``. 4 096 bucket counts tell which bucket holds the border; only
    that bucket is sorted to find the border row. The split itself is then a filter, with no shuffle.
    """
    hashed = df.withColumn("__h", digest(F.lit(seed), F.col(key)))
    bucket = F.substring("__h", 1, 3)
    counts = {row["b"]: row["n"] for row in hashed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    quota = int(sum(counts.values()) * ratio)
    before, border = 0, None
    for b in sorted(counts):
        if before + counts[b] > quota:
            border = b
            break
        before += counts[b]
    if border is None:
        return hashed.withColumn("is_train", F.lit(True)).drop("__h")
    inside = hashed.filter(bucket == border).select("__h", key).orderBy("__h", key)
    last = inside.limit(quota - before).agg(F.max(F.struct("__h", key)).alias("m")).first()["m"]
    if last is None:
        return hashed.withColumn("is_train", bucket < border).drop("__h")
    limit = F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("k"))
    is_train = F.struct(F.col("__h").alias("h"), F.col(key).alias("k")) <= limit
    return hashed.withColumn("is_train", is_train).drop("__h")
