"""The rows that meet in the two rounds of ``lsh``: how many there are, and that every pair of a bucket is among them."""

import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import lsh
from llm.linededup import dedup_lines, line_sets


def looked_up(texts, seen):
    """Texts by node, and how many rows asked for one."""

    def texts_of(rows):
        seen.append(rows.count())
        return rows.join(texts, F.col("ask") == F.col("node")).select(*rows.columns, "text")

    return texts_of


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK", 4)
    monkeypatch.setattr(lsh, "PARTS", 8)


def test_a_node_of_few_pairs_is_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(lsh, "PARTS", 8)
    # node 0 meets 8 others (one part), node 100 meets 40 (5 parts)
    near, far = "one line of some length to compare", "nothing of all that stands in here"
    pairs = [(0, b) for b in range(1, 9)] + [(100, b) for b in range(101, 141)]
    texts = spark.createDataFrame([(n, far if n % 2 else near) for p in pairs for n in p], "node long, text string").distinct()
    seen = []
    links = lsh.confirm(spark.createDataFrame(pairs, "a long, b long"), looked_up(texts, seen), line_sets, (80, 100))
    assert {tuple(r) for r in links.collect()} == {p for p in pairs if p[1] % 2 == 0}
    assert len(seen) == 1 and len(pairs) + 2 <= seen[0] <= len(pairs) + 6


def test_a_chain_of_buckets_makes_rows_in_proportion(spark, small_blocks):
    # bucket k holds nodes 2k, 2k+1, 2k+2: all buckets hang together, but a node lies in two at most
    state = spark.createDataFrame([(1000 + k, 2 * k + j, 2 * k + j) for k in range(100) for j in range(3)], "key long, node long, comp long")
    groups = state.select("node", F.lit(0).cast("long").alias("grp")).distinct()
    pairs = lsh.block_pairs(lsh.place_members(state, groups)).collect()
    assert len(pairs) <= 3 * 201  # 201 nodes in 51 blocks would be 201 * 51 rows
    units = {}
    for r in pairs:
        units.setdefault((r["grp"], r["i"], r["j"]), set()).add(r["ask"])
    met = {p for nodes in units.values() for p in combinations(sorted(nodes), 2)}
    assert met >= {(2 * k + a, 2 * k + b) for k in range(100) for a, b in ((0, 1), (0, 2), (1, 2))}


def test_a_bucket_of_many_blocks_stays_one_group(spark, small_blocks):
    # 30 nodes in each of 3 buckets: by bucket there would be three times the rows
    state = spark.createDataFrame([(k, n, n) for k in range(3) for n in range(30)], "key long, node long, comp long")
    groups = state.select("node", F.lit(-1).cast("long").alias("grp")).distinct()
    assert {tuple(r) for r in lsh.place_members(state, groups).collect()} == {(n, n, -1) for n in range(30)}


def test_round_two_moves_texts_and_no_sets(spark, small_blocks):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    texts = {i: base[i % 4][:-5] + f"{i:05d}" for i in range(40)}
    frame = spark.createDataFrame([*texts.items(), (3, ""), (5, None)], "node long, text string")
    placed = spark.createDataFrame([(i, i, 9) for i in texts], "node long, comp long, grp long")
    links = lsh.block_links(lsh.block_pairs(placed), lsh.texts_from(frame), line_sets, (80, 100), 56)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "members" not in plan
    found = {tuple(sorted(r)) for r in links.collect()}
    assert all(a % 4 == b % 4 for a, b in found)
    comp = {i: i for i in texts}
    for a, b in found:
        old, new = sorted((comp[a], comp[b]), reverse=True)
        comp = {n: new if c == old else c for n, c in comp.items()}
    assert comp == {i: i % 4 for i in texts}


def test_signatures_of_equal_texts_are_equal(spark):
    rows = spark.createDataFrame([(i, "the very same line of text") for i in range(50)] + [(50, ""), (51, None), (52, "another line of text")], "ask long, text string").coalesce(1)
    signed = {r["ask"]: bytes(r["signature"]) for r in lsh.with_signatures(rows, line_sets, 56).collect()}
    assert sorted(signed) == [*range(50), 52] and len({*signed.values()}) == 2 and {len(x) for x in signed.values()} == {56}


def test_lines_of_a_large_group(spark, small_blocks):
    """The same result whatever the size of blocks: near copies in chains, so that buckets hold several components."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line, rows = [word() for _ in range(12)], []
    for i in range(120):
        line[rnd.randrange(12)] = word()
        rows.append((i, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [set(s.tolist()) for s in line_sets(pa.array([t for _, t in rows]))]
    comp = list(range(120))
    for a, b in combinations(range(120), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, bands=40, rows=3).collect()}
    assert got == {i: t if comp[i] == i else "" for i, t in rows}
