import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in der die und von zu le la et que de los las el con por alpha beta gamma delta rho sigma tau".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash with inner ones."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(WORDS) for _ in range(30_000))
    body = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, body, "en", "a", 1),
        (4, body, "en", "a", 1),
        (5, body, None, "a", 1),
        (None, body, "en", None, 1),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "a", len(long)),
        (8, "12345 !!! <|endoftext|> <\\|im_end|>", "de", "b", 3),
        (9, "émile ça và ☃ 漢字 ́x  double", "fr", "b", 3),
        (10, "x", "es", "b", 1),
        (11, "\n".join([body, "short", body, body.upper() + " "]), "en", "a", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["tie", "keys", "node", "component", "kept", "line", "number", "places", "length", "part", "score", "lang_pred", "_id", "_tie", "n_words"]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
