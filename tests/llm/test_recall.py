"""Recall of the production bands over all true pairs: documents of sf0.1 (10,000) and 6,000 made lines at the threshold."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from llm.linededup import BANDS, ROWS, WIDTH, LineScan, line_sets
from llm.minmax import band_keys, signatures
from llm.neardup import shingle_sets


def true_pairs(sets, share):
    """All pairs with share[1] * intersection >= share[0] * union, by the rarest members of each set: exact."""
    often = Counter()
    for s in sets:
        often.update(s.tolist())
    index, out = defaultdict(list), []
    for i, s in sorted(enumerate(sets), key=lambda x: len(x[1])):
        members = sorted(s.tolist(), key=lambda x: (often[x], x))
        own, met = set(members), set()
        for x in members[: len(members) - math.ceil(len(members) * share[0] / share[1]) + 1]:
            met.update(index[x])
            index[x].append(i)
        for j in met:
            both = len(own.intersection(sets[j].tolist()))
            if share[1] * both >= share[0] * (len(own) + len(sets[j]) - both):
                out.append((i, j))
    return out


def recall(pairs, keys):
    return np.mean([bool((keys[i] == keys[j]).any()) for i, j in pairs])


def test_documents():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    sets = [s for a in range(0, len(texts), 500) for s in shingle_sets(texts.slice(a, 500), 3)]
    # equal sets are one node before any band is made
    sets = [np.frombuffer(b, np.uint64) for b in dict.fromkeys(s.tobytes() for s in sets if len(s))]
    assert len(texts) >= 10_000
    pairs = true_pairs(sets, (85, 100))
    keys = band_keys(signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 96), 6)[:, :32]
    assert len(pairs) > 50 and recall(pairs, keys) >= 0.99
    print(len(pairs), recall(pairs, keys))


def test_lines():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    lines = []
    for _ in range(560):
        base = [word() for _ in range(rnd.randint(25, 90))]
        for _ in range(10):
            # a word changed takes out some 13 runs: pairs lie around the threshold
            copy = list(base)
            for _ in range(rnd.randint(1, 3)):
                copy[rnd.randrange(len(copy))] = word()
            lines.append(" ".join(copy))
    lines = list(dict.fromkeys(lines))
    sets = line_sets(pa.array(lines))
    pairs = true_pairs(sets, (80, 100))
    found = {}
    for _, _, _, _, own, table in LineScan(WIDTH, BANDS * ROWS).texts(pa.array(["\n".join(lines)])):
        found.update(zip(own.tolist(), band_keys(table, ROWS)[:, :BANDS], strict=True))
    numbers = [n for _, _, n, _, _, _ in LineScan(WIDTH, BANDS * ROWS).texts(pa.array(["\n".join(lines)]))]
    keys = [found[h] for h in np.concatenate(numbers).tolist()]
    near = [p for p in pairs if 100 * len(np.intersect1d(sets[p[0]], sets[p[1]])) < 85 * len(np.union1d(sets[p[0]], sets[p[1]]))]
    assert len(lines) >= 5000 and len(pairs) > 5000 and len(near) > 1000
    assert recall(pairs, keys) >= 0.99 and recall(near, keys) >= 0.99
    print(len(pairs), recall(pairs, keys), len(near), recall(near, keys))
