"""Readers: question sets, catalogues, descriptions, links, predictions, vectors, samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlsql_spark.functions.text import normalize_text
from nlsql_spark.operators.linking import LINKS_TYPE, links_flat
from nlsql_spark.operators.ordering import ordered_position
from nlsql_spark.sources.json_array import array_elements

ENTRY_REQUIRED = ["db_id", "question", "evidence", "SQL"]
ENTRY_VARIANTS = {"train": [], "dev": ["question_id", "difficulty"], "train_with_steps": ["reasoning_steps"]}
ENTRY_SCHEMA = (
    "question_id bigint, db_id string, question string, evidence string, SQL string, difficulty string, "
    "reasoning_steps array<string>"
)
LINKS_SCHEMA = f"question_id bigint, question string, schema_links {LINKS_TYPE}"
EMBEDDING_SCHEMA = "example_id bigint, embedding array<float>"
SAMPLE_SCHEMA = "question_id bigint, prompt string, query string, reasoning_steps array<string>, question string"
PREDICTION_SCHEMA = (
    "input_data struct<id:string, input_mappings:map<string,string>>, response struct<sql:string>, error string, "
    "number_of_prompt_tokens bigint, number_of_generated_tokens bigint"
)
CATALOG_FILE_SCHEMA = (
    "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
    "column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def with_position(df: DataFrame, items: str, id_col: str) -> DataFrame:
    """Explode an array with the 0-based place of each item."""
    kept = [c for c in df.columns if c != items]
    return df.select(*kept, F.posexplode(items).alias(id_col, items))


def read_json_array(spark: SparkSession, path: str, id_col: str = "pos") -> DataFrame:
    """``pos, entry`` (entry as JSON text) of files that hold one JSON array each, numbered over all of them.

    Every task reads a byte range, however large a file is (``json_array``). A file that is no whole array fails.
    """
    return array_elements(spark, path, id_col=id_col)


def validate_entries(df: DataFrame, entry: str = "entry", variants: dict[str, list[str]] = ENTRY_VARIANTS) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): an entry must have exactly the fields of one variant, which ``variant`` names."""
    keys = F.col("__keys")

    def fits(extra: list[str]) -> Column:
        wanted = F.array(*[F.lit(k) for k in ENTRY_REQUIRED + extra])
        return (F.size(F.array_except(keys, wanted)) == 0) & (F.size(F.array_except(wanted, keys)) == 0)

    variant = F.lit(None).cast("string")
    for name, extra in variants.items():
        variant = F.when(fits(extra), F.lit(name)).otherwise(variant)
    tagged = df.withColumn("__keys", F.json_object_keys(entry)).withColumn("variant", variant).drop("__keys")
    return tagged.filter("variant is not null"), tagged.filter("variant is null").drop("variant")


def read_questions(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """A question set; entries without an id get their place in the file."""
    raw = read_json_array(spark, path)
    good, rejects = validate_entries(raw)
    if strict and not rejects.isEmpty():
        raise ValueError(f"entries with missing or unknown fields: {rejects.first()['entry'][:200]}")
    if limit is not None:
        good = good.filter(F.col("pos") < limit)
    e = good.select("pos", F.from_json("entry", ENTRY_SCHEMA).alias("e")).select("pos", "e.*")
    return e.select(
        F.coalesce("question_id", F.col("pos").cast("bigint")).alias("question_id"),
        F.col("db_id").alias("database_name"),
        "question",
        F.col("SQL").alias("sql_query"),
        F.col("evidence").alias("knowledge"),
        "difficulty",
        "reasoning_steps",
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with a declared schema; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def number_lines(df: DataFrame, order: Sequence[str], id_col: str = "question_id", **numbering) -> DataFrame:
    """Positional ids for a split table, in the given order."""
    return ordered_position(df, order, name=id_col, **numbering)


def catalog_columns(raw: DataFrame) -> DataFrame:
    """Catalogue entries to one row per column.

    The ``*`` pseudo column is left out, names are lower-cased, both sides of a foreign key are
    flagged, and a repeated (table, name) pair takes the flags of its first place.
    """
    flat_pk = F.transform(
        F.flatten(F.transform("primary_keys", lambda k: F.regexp_extract_all(k, F.lit(r"\d+"), F.lit(0)))),
        lambda d: d.cast("int"),
    )
    items = raw.select(
        F.col("db_id").alias("database_name"),
        "table_names_original",
        "column_types",
        flat_pk.alias("pk"),
        F.flatten("foreign_keys").alias("fk"),
        F.posexplode("column_names_original").alias("index", "c"),
        F.transform("column_names_original", lambda c: F.concat_ws("\x00", c)).alias("all"),
    )
    first = F.array_position("all", F.concat_ws("\x00", "c")).cast("int") - 1
    table_index = F.get("c", F.lit(0)).cast("int")
    kept = items.withColumns({"t": table_index, "first": first}).filter("t <> -1")
    return kept.select(
        "database_name",
        F.lower(F.get("table_names_original", F.col("t"))).alias("table_name"),
        F.col("t").alias("table_pos"),
        F.lower(F.get("c", F.lit(1))).alias("column_name"),
        F.col("index").alias("column_pos"),
        F.lower(F.get("column_types", F.col("index"))).alias("data_format"),
        F.lit(None).cast("string").alias("default_value"),
        F.lit(False).alias("is_not_null"),
        F.array_contains("pk", F.col("first")).alias("is_primary_key"),
        F.coalesce(F.array_contains("fk", F.col("first")), F.lit(False)).alias("is_foreign_key"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CATALOG_FILE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return catalog_columns(raw)


def read_column_descriptions(
    spark: SparkSession, folder: str, database_name: str, table_from: str = r"/([^/]+)\.csv$"
) -> DataFrame:
    """Description CSVs of one database (a file per table), all values trimmed and lower-cased.

    Of several rows for a column the last one counts. ``table_from`` finds the table in the file path.
    """
    cols = ["original_column_name", "column_name", "column_description", "data_format", "value_description"]
    raw = spark.read.csv(
        folder, header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in cols), pathGlobFilter="*.csv"
    )
    table_name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), table_from, 1)
    # files are not split, so the row ids of a file rise in file order
    clean = raw.select(
        F.lower(table_name).alias("table_name"),
        *[normalize_text(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols],
        F.monotonically_increasing_id().alias("__row"),
    )
    last = clean.groupBy("table_name", "original_column_name").agg(
        *[F.max_by(c, "__row").alias(c) for c in cols if c != "original_column_name"]
    )
    return last.select(F.lit(database_name).alias("database_name"), *["table_name", *cols])


class Registry:
    """Where each database's tables live: database name -> folder of Parquet tables."""

    def __init__(self, locations: dict[str, str]):
        self.locations = locations

    def scan(self, spark: SparkSession, database: str, table: str, columns: list[str] | None = None) -> DataFrame:
        folder = self.locations[database]
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        return df.select(*columns) if columns else df

    def session(self, spark: SparkSession, database: str, tables: list[str]) -> SparkSession:
        """A session of its own in which the tables of one database are views: databases may have tables of equal names."""
        own = spark.newSession()
        self.register_views(own, database, tables)
        return own

    def register_views(self, spark: SparkSession, database: str, tables: list[str]) -> None:
        for table in tables:
            self.scan(spark, database, table).createOrReplaceTempView(table)


def predictions(raw: DataFrame) -> DataFrame:
    """Responses to ``question_id, sql``; no response is an empty query."""
    return raw.select(
        F.col("input_data.id").cast("bigint").alias("question_id"), F.coalesce("response.sql", F.lit("")).alias("sql")
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return predictions(read_jsonl(spark, path, PREDICTION_SCHEMA))


def read_links(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    links = read_jsonl(spark, path, LINKS_SCHEMA)
    return links_flat(links) if flat else links


def read_training_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    samples = read_jsonl(spark, path, SAMPLE_SCHEMA)
    return samples if limit is None else samples.orderBy("question_id").limit(limit)


def read_embeddings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All chunk files of a folder, or all commits of a keyed store."""
    if path_exists(spark, f"{path}/commits"):
        from nlsql_spark.sources.keyed_store import read_store

        return read_store(spark, path)
    return spark.read.schema(EMBEDDING_SCHEMA).format(fmt).load(path)
