import itertools
import random

import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import linking as L
from nlsql_spark.operators.knn import knn
from nlsql_spark.operators.schema_text import link_from_pairs, repair_links

Q = "question_id long, database_name string, question string, sql_query string, knowledge string"


def links_of(df):
    return {r["question_id"]: [(x["table_name"], x["columns"]) for x in r["schema_links"]] for r in df.collect()}


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select avg(age) from person", [("person", ["age"])]),
        ('select species from animal where color = "black"', [("animal", ["color", "species"])]),
        (
            "select p.name, p.age, a.species from person p join animal a on p.name = a.owner",
            [("person", ["age", "name"]), ("animal", ["name", "owner", "species"])],
        ),
        ("select 1", []),
    ],
)
def test_substring(spark, make_catalog, sql, expected):
    catalog = make_catalog({"person": ["name", "age"], "animal": ["species", "owner", "color", "name"]})
    questions = spark.createDataFrame([(1, "db", "q", sql, None)], Q)
    assert links_of(L.link_by_substring(questions, catalog))[1] == expected


def test_substring_needs_a_catalogue(spark, make_catalog):
    questions = spark.createDataFrame([(1, "other", "q", "select 1", None)], Q)
    with pytest.raises(Exception, match="no catalogue for database other"):
        L.link_by_substring(questions, make_catalog({"t": ["c"]})).collect()


@pytest.mark.parametrize("word_boundary", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_names_in_one_pass(spark, monkeypatch, word_boundary, small):
    """Against a search per name: overlapping names, names inside names, signs, letters beyond ASCII, a hot database."""
    from nlsql_spark.operators import name_index as N
    from nlsql_spark.operators.linking import join_catalog, substring_links

    if not small:
        monkeypatch.setattr(N, "is_small", lambda df: False)
        monkeypatch.setattr(N, "GROUP_QUESTIONS", 40)
    rng = random.Random(word_boundary)
    pool = ["a", "ab", "b", "abc", "bc", "a_b", "É", "straße", "x.y", "(", "ABC", "order id", "id", "aa"]
    rows = []
    for db in ("hot", "cold"):
        for t, table in enumerate(rng.sample(pool, 7)):
            rows += [(db, table, t, c, p) for p, c in enumerate(rng.sample(pool, 5))]
    names = spark.createDataFrame(rows, "database_name string, table_name string, table_pos int, column_name string, column_pos int")
    flags = {c: F.lit(False) for c in ("is_not_null", "is_primary_key", "is_foreign_key")}
    catalog = names.withColumns({**flags, "data_format": F.lit("text"), "default_value": F.lit(None).cast("string")})
    text = lambda: "".join(rng.choice([*pool, " ", " ", ".", "A", "é", "_"]) for _ in range(rng.randint(0, 9)))
    questions = spark.createDataFrame([(i, "cold" if i % 5 == 0 else "hot", "q", text() if i else None, None) for i in range(300)], Q).repartition(4)
    joined = join_catalog(questions, catalog, "required")
    want = joined.select("question_id", substring_links(F.col("sql_query"), F.col("tables"), word_boundary).alias("schema_links"))
    got = links_of(L.link_by_substring(questions, catalog, word_boundary))
    assert got == {r["question_id"]: [(x["table_name"], x["columns"]) for x in r["schema_links"] or []] for r in want.collect()}
    assert sum(map(bool, got.values())) > 30


@pytest.mark.parametrize("most", [1, 60, 4_000_000])
def test_held_words_equal_joins(spark, monkeypatch, most):
    """Many questions in one batch: words of several tables, tables named by themselves, tables at one place, rows of an id in several databases."""
    rng = random.Random(most)
    pool = ["red", "blue", "old", "new", "ring", "gear", "bolt", "rod"]
    rows, names = [], [f"{a}_{b}" for a in pool[:4] for b in pool[4:]]
    for db in ("x", "y", "z"):
        for t, table in enumerate(rng.sample([*names, *pool], 7)):
            rows += [(db, table, t // 2, c, p) for p, c in enumerate(rng.sample(names, rng.randint(1, 6)))]
    catalog = spark.createDataFrame(rows, "database_name string, table_name string, table_pos int, column_name string, column_pos int")
    text = lambda: " ".join(rng.choice([*pool, *names, "nothing"]) for _ in range(rng.randint(0, 4)))
    asked = [(rng.choice([i, i // 3]), rng.choice("xyz"), text(), None) for i in range(200)]
    questions = spark.createDataFrame(asked, "question_id long, database_name string, question string, knowledge string").coalesce(2)
    lists = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    monkeypatch.setattr(L, "MOST_COLUMNS", most)
    single = questions.dropDuplicates(["question_id"]).localCheckpoint()
    held, alone = lists(L.link_by_tokens(questions, catalog)), lists(L.link_by_tokens(single, catalog, single_ids=True))
    monkeypatch.setattr(L, "is_small", lambda df: False)
    assert held == lists(L.link_by_tokens(questions, catalog)) and alone == lists(L.link_by_tokens(single, catalog))


@pytest.mark.parametrize("small", [True, False])
def test_links_keep_columns(spark, make_catalog, monkeypatch, small):
    """Columns of the questions stay beside the links, with NULLs and lists; rows of single ids have the links of their own text."""
    from nlsql_spark.operators import name_index as N

    if not small:
        for module in (L, N):
            monkeypatch.setattr(module, "is_small", lambda df: False)
    catalog = make_catalog({"person": ["full_name", "birth_date"], "pet": ["name", "owner"]}).unionByName(make_catalog({"pet": ["tail"]}, "zoo"))
    rows = [(1, "db", "which owner name", "select name from pet", None), (2, "zoo", "a pet", "select tail, owner from pet", "k"), (3, "db", None, None, "n"), (4, "db", "of", "select full_name from person", "")]
    questions = spark.createDataFrame(rows, Q).withColumn("more", F.array("knowledge"))
    keep = ("database_name", "knowledge", "more")
    for f, options in ((L.link_by_substring, {}), (L.link_by_tokens, {}), (L.link_by_tokens, {"single_ids": True})):
        kept = f(questions, catalog, keep=keep, **options)
        assert kept.columns == ["question_id", "question", *keep, "schema_links"]
        assert links_of(kept) == links_of(f(questions, catalog))
        assert {(r["question_id"], r["question"], r["database_name"], r["knowledge"], *r["more"]) for r in kept.collect()} == {(i, q, db, k, k) for i, db, q, _, k in rows}


@pytest.mark.parametrize(
    "question, knowledge, use, distance, expected",
    [
        ("free meal rate for 2020", None, False, 0, [("frpm", ["free_meal_rate"])]),
        ("Details for 2020 FRPM", None, False, 0, [("frpm", ["free_meal_rate", "academy"])]),
        ("nothing here", None, False, 0, [("", [])]),
        ("nothing here", "free meals information", True, 0, [("frpm", ["free_meal_rate"])]),
        ("the academyx", None, False, 0, [("", [])]),
        ("the academyx", None, False, 1, [("frpm", ["academy"])]),
        ("the academmc", None, False, 1, [("", [])]),
        ("the academmc", None, False, 2, [("frpm", ["academy"])]),
        ("the academmcc", None, False, 3, [("frpm", ["academy"])]),
    ],
)
def test_tokens(spark, make_catalog, question, knowledge, use, distance, expected):
    catalog = make_catalog({"frpm": ["free_meal_rate", "academy"], "schools": ["city"]})
    questions = spark.createDataFrame([(7, "db", question, "", knowledge)], Q)
    out = L.link_by_tokens(questions, catalog, distance, use_knowledge=use)
    got = links_of(out)[7]
    # at distance 3 short names are near nearly every word; only the table under test matters
    assert [x for x in got if x[0] != "schools"] == expected


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_similar_tokens_is_exact(spark, distance):
    rng = random.Random(distance)
    word = lambda low: "".join(rng.choice("abc") for _ in range(rng.randint(low, 9)))
    left, right = ({word(low) for low in (1, 1, 3) for _ in range(60)} for _ in range(2))
    frame = lambda words: spark.createDataFrame([("db", w) for w in words], "database_name string, token string")
    got = {(r["left_token"], r["right_token"]) for r in L.similar_tokens(frame(left), frame(right), distance).collect()}
    assert got == {(a, b) for a, b in itertools.product(left, right) if _lev(a, b) <= distance}


def test_knn_and_embedding_links(spark):
    vec = "example_id long, embedding array<float>"
    docs = spark.createDataFrame([(123, [1.0, 2.0, 3.0]), (122, [1.0, 2.0, 2.0]), (321, [3.0, 2.0, 1.0])], vec)
    query = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], vec)
    raw = spark.createDataFrame(
        [(122, "cooks", "height"), (123, "cooks", "name"), (321, "dishes", "name")],
        "document_id long, table_name string, col_name string",
    )
    link = lambda k: links_of(L.link_by_embedding(knn(query, docs, k), raw))[1]
    assert link(1) == [("cooks", ["name"])]
    assert link(2) == [("cooks", ["height", "name"])]
    assert link(10) == [("cooks", ["height", "name"]), ("dishes", ["name"])]


def test_knn_block_path_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "example_id long, embedding array<float>")
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    want = {
        q: [d for _, d in sorted((dist(v, w), d) for d, w in rows)[:5]] for q, v in rows
    }
    for limits in ({"block_queries": 64, "block_docs": 50}, {}):
        got = {}
        for r in knn(df, df, 5, **limits).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want


def test_knn_by_cells_on_clusters(spark):
    """Far clusters, copies of one vector, fewer docs than k, several query blocks in one cell."""
    import numpy as np

    from nlsql_spark.operators import knn as module

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 50
    docs = [(i, (centres[i % 12] + rng.normal(size=6)).round(3).tolist()) for i in range(600)] + [(1000 + i, centres[0].tolist()) for i in range(200)]
    queries = [(i, (centres[i % 3] + rng.normal(size=6) * 2).round(3).tolist()) for i in range(90)]
    kind = "example_id long, embedding array<double>"
    d, q = spark.createDataFrame(docs, kind), spark.createDataFrame(queries, kind)
    x, ids = np.array([v for _, v in docs]), np.array([i for i, _ in docs])
    for k in (1, 7, 250, 900):
        got = {}
        for r in module.knn(q, d, k, block_queries=16, block_docs=50).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        for i, v in queries:
            order = np.lexsort((ids, ((x - np.array(v)) ** 2).sum(1)))[:k]
            assert got[i] == ids[order].tolist()
    # few cells are within reach of a query, and none that holds an answer is left out
    placed, cells = module.voronoi_cells(d)
    where = {r["example_id"]: r["cell"] for r in placed.collect()}
    far = cells.distances(np.array([v for _, v in queries]))
    reach = np.array([np.sort(np.sqrt(((x - np.array(v)) ** 2).sum(1)))[4] for _, v in queries])
    found = cells.cells_in_reach(far, reach)
    for row, (_, v) in enumerate(queries):
        near = ids[np.lexsort((ids, ((x - np.array(v)) ** 2).sum(1)))[:5]]
        assert all(found[row, where[n]] for n in near)
    assert (found * cells.n).sum() < 0.25 * len(queries) * len(docs)
    assert module.knn(q, d.limit(0), 3, block_queries=16).count() == 0


def test_knn_with_many_copies(spark, monkeypatch):
    """A third of the documents are one vector; ties go to the lowest ids, in small slices too."""
    from nlsql_spark.operators import knn as module

    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), 2.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "example_id long, embedding array<float>")
    query = spark.createDataFrame([(7, [1.0, 1.0]), (8, [1.0, 1.1])], "example_id long, embedding array<float>")
    monkeypatch.setattr(module, "MATRIX_CELLS", 100)
    got = knn(query, df.coalesce(1), 4).orderBy("query_id", "rank").collect()
    # the copies 0, 3, 6, ... are nearest and tie with each other
    assert [r["doc_id"] for r in got] == [0, 3, 6, 9, 0, 3, 6, 9]
    local = module._block_top(*(module.np.array(x) for x in ([[1.0, 1.0]], [7], [v for _, v in rows], [i for i, _ in rows])), 4)
    assert list(local["doc_id"]) == [0, 3, 6, 9]


def test_repair(spark, make_catalog):
    catalog = make_catalog({"t": [("id", True, False), "a", ("ref", False, True), "b"], "u": ["x", "y"]})
    schema = f"question_id long, question string, database_name string, schema_links {L.LINKS_TYPE}"
    given = [(' "T` ', ["B", "zz"]), ("ghost", ["a"]), ("u", ["nope"])]
    df = spark.createDataFrame([(1, "q", "db", given), (2, "q", "db", [])], schema)
    got = links_of(repair_links(df, catalog))
    assert got[1] == [("t", ["b", "id", "ref"]), ("u", ["x", "y"])]
    assert got[2] == []


def test_links_from_pairs(spark, make_catalog):
    catalog = make_catalog({"t": [("id", True, False), "a"], "u": ["x"]})
    schema = "question_id long, question string, database_name string, pairs array<struct<table_name:string,column_name:string>>"
    df = spark.createDataFrame([(1, "q", "db", [("u", "x"), ("T", "A"), ("T", "A")]), (2, "q", "db", None)], schema)
    got = links_of(link_from_pairs(df, catalog))
    assert got == {1: [("t", ["a", "id"]), ("u", ["x"])], 2: []}


def test_mentioned_columns(spark, make_catalog):
    """The rows of all pairs, also for repeated questions, null texts and unknown databases; columns of unnamed tables are not met."""
    from nlsql_spark.functions.text import mentioned

    catalog = make_catalog({"Person": ["Id", "name", "age"], "pet": ["id", "Owner"], "a": ["pet", "x"]})
    texts = ["select AGE from PERSON", "select id, owner FROM Pet", None, "", "x", "select name from person, pet"]
    rows = [(i, "db", t) for i, t in enumerate(texts)] + [(1, "db", texts[1]), (9, "other", texts[0]), (10, None, texts[0])]
    questions = spark.createDataFrame(rows, "question_id long, database_name string, sql_query string")
    found = sorted(map(tuple, L.mentioned_columns(questions, catalog).collect()))
    pairs = questions.join(catalog, "database_name").filter(mentioned(F.col("table_name"), F.col("column_name"), F.col("sql_query")))
    assert found == sorted(map(tuple, pairs.select("question_id", "table_name", "column_name").collect())) and len(found) == 7


def test_knn_searches_equal_vectors_once(spark, monkeypatch):
    from nlsql_spark.operators import knn as module

    asked, search = [], module.knn_by_cells

    def counted(queries, *args, **kwargs):
        asked.append(queries.count())
        return search(queries, *args, **kwargs)

    monkeypatch.setattr(module, "knn_by_cells", counted)
    schema = "example_id long, embedding array<float>"
    docs = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(40)], schema)
    # id 0 stands twice and counts as one query: its hits come twice and share the ranks
    queries = spark.createDataFrame([(i, [float(i % 4), 0.5]) for i in [*range(60), 0]], schema)
    found = {}
    for r in module.knn(queries, docs, 3, block_queries=8).collect():
        found.setdefault(r["query_id"], []).append((r["distance"], r["doc_id"], r["rank"]))
    assert asked == [4]
    for i in range(60):
        near = sorted(((i % 4 - d) ** 2 + (0.5 - d % 3) ** 2, d) for d in range(40))[:3]
        near = near if i else [near[0], near[0], near[1]]
        assert sorted(found[i], key=lambda x: x[2]) == [(*x, r) for r, x in enumerate(near, 1)]


def test_token_links_of_held_words(spark, make_catalog, monkeypatch):
    """The words of a small catalogue are held by the tasks; the links are those of the joins, whatever ids and texts the rows have."""
    catalog = make_catalog({"person": ["full_name", "birth_date"], "pet": ["name", "owner"]}).unionByName(make_catalog({"pet": ["tail"]}, "zoo"))
    rows = [(1, "db", "which owner name"), (1, "zoo", "pet tail"), (2, "db", "birth date of a person"), (2, "db", "birth date of a person"), (3, "db", None),
            (4, "db", "of"), (None, "db", "owner name"), (5, "none", "owner"), (6, None, "owner"), (7, "db", "person name pet")]
    questions = spark.createDataFrame([(*r, None) for r in rows], "question_id long, database_name string, question string, knowledge string")
    text = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    held, used = [], L.held_links
    monkeypatch.setattr(L, "held_links", lambda *args: held.append(1) or used(*args))
    found = text(L.link_by_tokens(questions, catalog))
    assert held
    monkeypatch.setattr(L, "is_small", lambda df: False)
    assert found == text(L.link_by_tokens(questions, catalog)) and len(found) == len(rows)
