"""The keyed vector store and the ledger of replies: every id stored once, every prompt asked once."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nlsql_spark.operators import model_steps as M
from nlsql_spark.sources import keyed_store as K

TEXTS = "example_id long, input_to_embed string"


def texts(spark, rows):
    return spark.createDataFrame(rows, TEXTS).repartition(3)


def test_filters():
    rng = np.random.default_rng(1)
    ids, others = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-(1 << 62), 1 << 62, 20000)
    bits = K.bloom(ids)
    assert K.may_hold(bits, ids).all()
    assert K.may_hold(bits, others).mean() < 0.02
    assert not K.may_hold(K.bloom(np.array([], np.int64)), others).any()


def test_repeated_ids_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "store")
    lengths = lambda asked: [[float(len(t)), 1.0] for t in asked]
    out = M.embed_incremental(texts(spark, [(1, "bb"), (1, "a"), (2, "ccc"), (None, "x")]), store, lengths, normalize=False)
    # of several texts of an id the smallest counts
    assert sorted((r["example_id"], r["embedding"][0]) for r in out.collect()) == [(1, 1.0), (2, 3.0)]
    out = M.embed_incremental(texts(spark, [(2, "other"), (3, "dddd"), (3, "dddd")]), store, lengths, normalize=False)
    assert sorted((r["example_id"], r["embedding"][0]) for r in out.collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    assert M.embed_incremental(texts(spark, []), store, lengths, normalize=False).count() == 3


def test_commits(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    embed = lambda todo: M.embed(todo, dim=2)
    K.append(texts(spark, [(1, "a")]), store, embed, "s-1")
    # a batch that was committed is not done again
    K.append(texts(spark, [(1, "a"), (2, "b")]), store, embed, "s-1")
    assert K.read_store(spark, store).count() == 1
    # data without a manifest does not count
    K.write_segment(M.embed(texts(spark, [(9, "z")]), dim=2), texts(spark, [(9, "z")]), store, "s-2")
    os.remove(f"{store}/commits/s-2/_SUCCESS")
    assert K.read_store(spark, store).count() == 1 and K.pending_rows(texts(spark, [(9, "z"), (1, "a")]), store).collect()[0]["example_id"] == 9
    # merged commits hold the same, and their keys are still known
    monkeypatch.setattr(K, "MOST_COMMITS", 2)
    for n in range(3, 8):
        K.append(texts(spark, [(n, "t"), (n + 1, "u")]), store, embed, f"s-{n}")
    K.append(texts(spark, [(77, "t")]), store, embed, "s-3")
    assert sorted(r["example_id"] for r in K.read_store(spark, store).collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert K.manifest(spark, store).select("segment").distinct().count() < 6


def test_a_batch_of_new_ids_reads_no_data(spark, tmp_path, monkeypatch):
    """The lookup opens only buckets in which a filter knows one of the ids."""
    store = str(tmp_path / "store")
    for n in range(3):
        K.append(texts(spark, [(1000 * n + i, f"t{i}") for i in range(400)]), store, lambda todo: M.embed(todo, dim=2))
    read = []
    kind = type(spark.read)
    monkeypatch.setattr(kind, "parquet", lambda self, *paths, f=kind.parquet, **o: (read.extend(p for p in paths if "/data/" in p), f(self, *paths, **o))[1])
    asked = texts(spark, [(10_000 + i, "new") for i in range(20)])
    assert K.pending_rows(asked, store).count() == 20
    new = len(read)
    read.clear()
    # filters that are too large for the tasks are dealt out and find the same
    monkeypatch.setattr(K, "FILTER_BYTES", 0)
    assert K.pending_rows(asked.unionByName(texts(spark, [(1005, "old")])), store).count() == 20
    read.clear()
    assert K.pending_rows(texts(spark, [(1005, "old"), (10_000, "new")]), store).count() == 1
    assert new <= 6 and 1 <= len(read) <= 3  # of 48 buckets


def calls(folder):
    return [json.loads(line) for f in glob.glob(f"{folder}/*.log") for line in open(f)]


@pytest.fixture
def counting(tmp_path):
    """A model that writes down what it is asked; ``die`` names a prompt that kills its task once."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def make(die=None):
        def model(prompts):
            with open(f"{folder}/{os.getpid()}.log", "a") as log:
                log.write(json.dumps(prompts) + "\n")
            if die in prompts and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            return [p.upper() for p in prompts]

        return model

    return make, str(folder)


def test_ledger_over_two_runs(spark, tmp_path, counting):
    make, folder = counting
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(50)] + [(7, "p7")], "id long, prompt string").repartition(4)
    out = M.generate(df.filter("id < 30"), make(), batch_size=4, ledger=ledger)
    for _ in range(2):  # an action that is repeated asks nothing again
        assert {r["id"]: r["response"] for r in out.collect()} == {i: f"P{i}" for i in range(30)}
    again = M.generate(df, make(), batch_size=4, ledger=ledger)
    assert sorted((r["id"], r["response"], r["error"]) for r in again.collect()) == sorted([(i, f"P{i}", None) for i in range(50)] + [(7, "P7", None)])
    asked = [p for batch in calls(folder) for p in batch]
    assert sorted(set(asked)) == sorted(f"p{i}" for i in range(50)) and len(asked) <= 51
    # another prompt under a known id is asked
    changed = M.generate(spark.createDataFrame([(3, "new")], "id long, prompt string"), make(), ledger=ledger)
    assert changed.first()["response"] == "NEW"


def test_ledger_after_a_lost_worker(tmp_path, counting):
    """A task whose worker dies half-way goes on behind the replies it has written."""
    import subprocess
    import sys

    _, folder = counting
    code = f"""
import json, os, sys
from pyspark.sql import SparkSession
from nlsql_spark.operators import model_steps as M
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def model(prompts):
    with open("{folder}/calls.log", "a") as log:
        log.write(json.dumps(prompts) + "\\n")
    if "p33" in prompts and not os.path.exists("{folder}/died"):
        open("{folder}/died", "w").close()
        os._exit(1)
    return [p.upper() for p in prompts]

df = spark.range(40).selectExpr("id", "concat('p', id) AS prompt").repartition(1).sortWithinPartitions("id")
out = M.generate(df, model, batch_size=4, ledger="{tmp_path}/ledger").collect()
print(json.dumps(sorted((r["id"], r["response"], r["error"]) for r in out)))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=root, env={**os.environ, "PYTHONPATH": root})
    assert json.loads(done.stdout.strip().splitlines()[-1]) == [[i, f"P{i}", None] for i in range(40)], done.stderr[-2000:]
    batches = calls(folder)
    assert os.path.exists(f"{folder}/died")
    # only the batch in which the worker died is asked twice
    twice = [b for b in batches if "p33" in b]
    assert len(batches) == 11 and len(twice) == 2 and twice[0] == twice[1]
    assert sorted(p for b in batches for p in b) == sorted([f"p{i}" for i in range(40)] + twice[0])


def test_ledger_keeps_no_errors(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string").coalesce(1)

    def picky(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return prompts

    for _ in range(2):
        rows = {r["id"]: r for r in M.generate(df, picky, max_retries=0, ledger=ledger).collect()}
        assert rows[1]["response"] == "good" and rows[2]["response"] is None and "no" in rows[2]["error"]
    assert {r["response"] for r in M.generate(df, lambda p: p, ledger=ledger).collect()} == {"good", "bad"}
    assert M.ledger_replies(spark, ledger).filter(F.col("id") == "1").count() == 1
