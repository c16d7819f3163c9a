"""The prefix trie against a plain one in dictionaries and against SQL, and the double array by itself."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import trie
from llm.doublearray import DoubleArray
from llm.q_trie import ORACLE_OP13, op13_prefix_trie
from tests.llm.conftest import SF

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    rnd = random.Random(seed)
    wide = [2, 5, 400][seed % 3]
    seqs = sorted({tuple(rnd.randrange(wide) for _ in range(rnd.randrange(0, 9))) for _ in range(300)})
    codes = np.array([c for s in seqs for c in s], np.int64)
    da = DoubleArray(codes, np.array([len(s) for s in seqs]))
    state, prefixes = defaultdict(set), {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    for d, (active, to) in enumerate(da.walk(), 1):
        for i, t in zip(active, to):
            state[seqs[i][:d]].add(int(t))
    assert set(state) == prefixes and all(len(s) == 1 for s in state.values())
    assert len({next(iter(s)) for s in state.values()}) == len(prefixes) == (da.check >= 0).sum() - 1
    # compact: at most a few places for each node
    assert len(da.base) < 4 * len(prefixes) + 2 * wide + 64


def plain(rows):
    """The contract in dictionaries."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            words[seq[:d]] = len(re.findall(r"[^\x20\x09-\x0D]+", seq[d - 1][1])) if d else 0
        ends[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words[node] + sum(saved[k] for k in kids[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def built(df, **how):
    out = trie.prefix_trie(trie.rebuilt(trie.turn_sequences(df)), **how).select(*NAMES)
    return sorted(map(tuple, out.collect()))


def made(seed=1, convs=260):
    """Shared first turns, copies of whole conversations, long common chains, nulls and ties."""
    rnd = random.Random(seed)
    rows, chain = [], [("user", f"chain {i} of words") for i in range(40)]
    for c in range(-30, convs):
        kind = rnd.randrange(5)
        if kind == 0:
            turns = [("user", "hello"), ("assistant", "hello there"), ("user", rnd.choice("abc"))][: rnd.randrange(1, 4)]
        elif kind == 1:
            turns = chain[: rnd.randrange(1, 41)] + [("user", rnd.choice("xyz"))] * rnd.randrange(2)
        elif kind == 2:
            turns = [(None, None), ("", "")] * rnd.randrange(1, 3)
        elif kind == 3:
            turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["a b", "a\tb ", "c", " d e"])) for _ in range(rnd.randrange(1, 7))]
        else:
            turns = [("user", "hot")] + [("assistant", f"own {c} {i}") for i in range(rnd.randrange(4))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(500, None, "user", "first"), (500, None, "assistant", "null turns"), (500, 3, "user", "x"), (500, 3, "user", "x"), (500, 3, "bot", "tie")]
    rows += [(None, 1, "user", "without id"), (520, 0, None, None)]
    return rows


def test_against_dictionaries(spark):
    rows = made()
    clash = {c: F.lit("clash") for c in ("keys", "seq", "cut", "shard", "node", "parent", "depth", "t")}
    df = spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(5)
    want = plain(rows)
    assert built(df) == want
    # small shards: prefixes are cut again and again, and nodes are shared by many tries
    for limit in (1, 7, 60):
        assert built(df, shard_turns=limit) == want


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 64)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(1000 + c, 0, "user", "other") for c in range(0, 200, 20)]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = lambda: sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_OP13})").fetchall())
    found = sorted(map(tuple, op13_prefix_trie(spark, SF).select(*NAMES).collect()))
    assert found == sql()
    assert found == plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    con.execute("CREATE OR REPLACE TEMP TABLE made(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?, ?)", made(2))
    con.execute("DROP VIEW conversations; CREATE VIEW conversations AS SELECT * FROM made")
    assert sql() == plain(made(2))


def test_empty_and_long(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(20, t, "user", f"turn {t}" + (" changed" if t > 2500 else "")) for t in range(2600)] + [(40, 0, "user", "w " * 200_000)]
    assert built(spark.createDataFrame(rows, SCHEMA), shard_turns=500) == plain(rows)
