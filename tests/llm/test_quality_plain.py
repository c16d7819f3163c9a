"""op5's distances and verdict against a computation of its own, over a whole table."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

from llm import quality as Q
from llm.q_quality import op5_quality_rules
from tests.llm.conftest import SF


def classes_of(text):
    out = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        if kind[0] == "L":
            out[kind == "Lu"] += 1
        elif kind == "Nd":
            out[2] += 1
        elif c in " \t\n\v\f\r":
            out[3] += 1
        else:
            out[4 if c in ".,;:!?'\"()-" else 5] += 1
    return out


def distance(counts, shares):
    total = sum(counts)
    p = [c / total for c in counts]
    m = [(a + b) / 2 for a, b in zip(p, shares)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (part(p) + part(shares)) / 2))


def repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    return len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})


def test_verdicts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    words = {r["doc_id"]: [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w] for r in docs}
    seen, classes = defaultdict(Counter), defaultdict(lambda: [0] * 6)
    for r in docs:
        if r["lang"] is not None:
            seen[r["lang"]].update(words[r["doc_id"]])
            if words[r["doc_id"]]:
                classes[r["lang"]] = [a + b for a, b in zip(classes[r["lang"]], classes_of(r["text"]))]
    refs = []
    for lang, counts in seen.items():
        lettered = [w for w in counts if any(unicodedata.category(c)[0] == "L" for c in w)]
        common = sorted(lettered, key=lambda w: (-counts[w], w.encode()))[: Q.COMMON]
        shares = [counts[w] / sum(counts.values()) for w in common]
        shares.append(max(0.0, 1 - sum(shares)))
        refs.append(([c / sum(classes[lang]) for c in classes[lang]], common, shares, distance([0.0] * len(common) + [1.0], shares)))
    got = {r["doc_id"]: r for r in op5_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    verdicts = Counter()
    for r in docs:
        own, text, out = words[r["doc_id"]], r["text"] or "", got[r["doc_id"]]
        n = len(own)
        by_class = min(distance(classes_of(text), ref[0]) for ref in refs) if len(text) >= Q.MIN_CHARS else None
        told = Counter(own)
        each = [(distance([*(told[w] for w in common), n - sum(told[w] for w in common)], shares), bare) for _, common, shares, bare in refs] if n >= Q.MIN_WORDS else []
        by_word, share = (min(d for d, _ in each), min(d / bare for d, bare in each)) if each else (None, 0.0)
        for mine, theirs in ((by_class, out["class_distance"]), (by_word, out["word_distance"])):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-9)
        failed = n < 10 or 100 * repeated(own) > 20 * n
        far = (by_class or 0) > Q.MAX_CLASS_DISTANCE or share > Q.MAX_WORD_SHARE or ((by_class or 0) > Q.MAX_BOTH[0] and share > Q.MAX_BOTH[1])
        assert out["base_failed"] == failed and out["kept"] == (not failed and not far), r["doc_id"]
        verdicts[failed, far] += 1
    assert len(verdicts) >= 3 and verdicts[False, False] > len(docs) / 2
