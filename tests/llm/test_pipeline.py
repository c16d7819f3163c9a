"""The stages of the corpus pipeline on planted documents."""

import random
from collections import Counter

import corpus_pipeline
from llm.tokens import TextEncoder
from tests.llm.conftest import SF, WORDS
from tests.llm.test_docs_ops import BYTE, components_of, hits_of, line_sets, shingles


def test_stages_keep_columns_and_clean_documents(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(f"clean{i} words{i * 7} here{i * 3}" for i in range(80))
    near = clean.replace("clean40", "other")
    rows = [(9_001, clean, "en"), (9_002, near, "en"), (9_003, "intro " + item + " end", "en"), (9_004, None, None), (9_005, "... 123", "en"), (9_006, "wholly different text of its own, alone in the world", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = base.unionByName(docs, allowMissingColumns=True)
    ids, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = corpus_pipeline.stored(out)
        ids[name] = {r[0] for r in docs.select("doc_id").distinct().collect()}
        if name != "packing":
            assert docs.columns == names
    assert not {9_004, 9_005} & ids["language_id"] and {9_001, 9_002, 9_003, 9_006} <= ids["line_dedup"] | {9_002}
    assert 9_002 not in ids["near_dedup"] and {9_001, 9_003, 9_006} <= ids["near_dedup"]
    assert 9_003 not in ids["decontamination"] and {9_001, 9_006} <= ids["packing"]
    assert ids["packing"] == ids["decontamination"]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def plain_pipeline(rows, items):
    """All stages by all pairs; rows: (doc_id, text, lang). Gives the rows before packing, in any order."""
    # language: no letter, no language
    rows = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    # lines: the first of each component of similar lines stays; rows of equal id and text are one document
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    places = {(r, k): x for r in order for k, x in enumerate(r[1].split("\n")) if x.strip(" \t\n\v\f\r")}
    comp = components_of({n: line_sets(x) for n, x in enumerate(places.values())}, 80)
    first, gone = {}, {}
    for n, place in enumerate(places):
        if first.setdefault(comp[n], place) != place:
            gone.setdefault(place[0], set()).add(place[1])
    cut = lambda r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r[:2], ()))
    rows = [(r[0], cut(r), r[2]) for r in rows if r[:2] not in gone or cut(r).split()]
    # near duplicates: the smallest id of each component stays
    comp = components_of({i: shingles(t, 5) for i, t, _ in rows if i is not None}, 80)
    rows = [r for r in rows if r[0] is None or comp[r[0]] == r[0]]
    return [r for r in rows if not hits_of(r[1], items)[1]]


def test_run_against_all_pairs(spark, tmp_path):
    rnd = random.Random(3)
    english, german = WORDS[:6], WORDS[6:12]
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    line = lambda common, n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else word() for _ in range(n))
    items = [(1, line(english, 14)), (2, line(english, 4)), (None, line(german, 12)), (3, None), (4, "")]
    shared = [line(english, 12) for _ in range(5)]
    rows = []
    for i in range(60):
        common, lang = (english, "en") if i % 2 else (german, "de")
        lines = [line(common, rnd.randint(8, 30)) for _ in range(rnd.randint(2, 5))]
        if rnd.random() < 0.5:
            x = rnd.choice(shared)
            lines.insert(rnd.randrange(len(lines)), rnd.choice([x, x.upper(), " " + x + "\t", x + "!"]))
        if rnd.random() < 0.2:
            lines.append("intro " + rnd.choice(items[:3])[1] + " end")
        rows.append((i, "\n".join(lines), lang if rnd.random() < 0.8 else None))
    long = [line(english, 12) for _ in range(6)]
    # near copies as one line each, which differ too much for the lines and little enough for the documents
    rows += [(100 + i, " ".join([*" ".join(long).split()[: 72 - i]]), "en") for i in range(3)]
    rows += [(200, rows[3][1], "en"), rows[5], rows[5], (None, line(english, 20), "en"), (201, None, "en"), (202, "", None), (203, "... 12 !", "en"), (204, "solo", None)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, g, None, None if t is None else len(t)) for i, t, g in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    want = plain_pipeline(rows, [x for x in items if x[1]])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        if name == "language_id":
            # the prediction fills what was not known
            assert {r["lang"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 2} == {"en"}
            assert docs.filter("lang is null").count() == 0
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(((i, t) for i, t, _ in want), key=str)
    tokenizer = TextEncoder(BYTE).tokenizer
    sizes = Counter()
    for i, text, _ in want:
        sizes[i] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    out = corpus_pipeline.run(spark, folder).collect()
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == sizes
    bins = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= corpus_pipeline.CAPACITY


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_without_labels_letters_decide(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()] == [1]
