"""Linear probe: labelled contexts from retry samples, a classifier on frozen vectors, its report."""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions.binding import let
from nlsql_spark.functions.text import strip


def labelled_items(steps: Column) -> Column:
    """Step list to ``ARRAY<STRUCT<text, label>>``.

    Both layouts are read: ``"wrong [BACK] right"`` inside one item, and ``"wrong[BACK]"`` as its own.
    """
    item = lambda text, label: F.struct(strip(text).alias("text"), F.lit(label).alias("label"))

    def parse(step: Column) -> Column:
        parts = F.split(step, r" \[BACK\] ")
        pair = F.array(item(F.get(parts, 0), K.LABEL_WRONG), item(F.get(parts, 1), K.LABEL_CORRECT))
        lone = F.array(item(F.replace(step, F.lit(K.BACK), F.lit("")), K.LABEL_WRONG))
        return (
            F.when(F.contains(step, F.lit(f" {K.BACK} ")), pair)
            .when(F.contains(step, F.lit(K.BACK)), lone)
            .otherwise(F.array(item(step, K.LABEL_CORRECT)))
        )

    return F.flatten(F.transform(steps, parse))


def probe_contexts_column(steps: Column) -> Column:
    """Cumulative contexts ``ARRAY<STRUCT<context, label>>`` of one step list.

    A right step gives all right texts so far; a wrong step gives the previous context plus its text.
    """
    start = F.expr(
        "named_struct('done', cast(array() as array<struct<context:string,label:int>>), 'rights', '')"
    )

    def add(state: Column, item: Column) -> Column:
        done, rights, text = state["done"], state["rights"], item["text"]
        wrong = item["label"] == K.LABEL_WRONG
        before = F.when(wrong, F.try_element_at(done, F.lit(-1))["context"]).when(rights != "", rights)
        context = F.coalesce(F.concat(before, F.lit(" "), text), text)
        return let(
            context,
            lambda c: F.struct(
                F.concat(done, F.array(F.struct(c.alias("context"), item["label"].alias("label")))).alias("done"),
                F.when(wrong, rights).otherwise(c).alias("rights"),
            ),
        )

    return F.aggregate(labelled_items(steps), start, add, lambda state: state["done"])


def probe_contexts(samples: DataFrame, key: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """One row per context: key, ``item`` number, ``text`` with the prompt in front, ``label``."""
    head = F.concat(
        F.lit(f"{K.CONTEXT} "), F.col("prompt"), F.lit(f"{K.QUESTION} "), F.col("question"), F.lit(f"\n{K.REASONING} ")
    )
    # the outer form keeps Spark from adding a size filter that would evaluate the contexts twice
    tall = samples.select(
        *key, head.alias("__head"), F.posexplode_outer(probe_contexts_column(F.col("reasoning_steps"))).alias("item", "c")
    ).filter("item is not null")
    return tall.select(*key, "item", F.concat("__head", "c.context").alias("text"), F.col("c.label").alias("label"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == K.LABEL_WRONG).alias("wrong"),
        F.count_if(F.col(label) != K.LABEL_WRONG).alias("correct"),
    )


def binary_report(df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """Mean loss, F1 of the positives, balanced accuracy and the four confusion counts, in one pass."""
    y, p, q = F.col(label) == 1, F.col(prediction) == 1, F.col(probability).cast("double")
    bounded = F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))
    cells = df.agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
        F.avg(-F.when(y, F.ln(bounded)).otherwise(F.ln(1 - bounded))).alias("loss"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return cells.select(
        "loss",
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        # a class that does not occur is left out of the mean
        F.coalesce((recall + specificity) / 2, recall, specificity).alias("balanced_accuracy"),
        "tn", "fp", "fn", "tp",
    )


def train_probe(df: DataFrame, vector: str = "embedding", label: str = "label", **params) -> LogisticRegressionModel:
    data = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(**params).fit(data)


def score_probe(model: LogisticRegressionModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``probability`` of the wrong class and ``prediction`` (probability > 0.5)."""
    with_features = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    scored = model.transform(with_features)
    p = vector_to_array("probability")[1]
    return scored.withColumns({"prediction": (p > 0.5).cast("int"), "probability": p}).drop("features", "rawPrediction")
