"""Very long texts: equal ids and hashes however a text is cut, and bounded memory of a worker."""

import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from llm.tokens import TextEncoder, border

PATHS = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PARTS = ["the", " of", "\n", "  ", "\t", " ", "漢字。", "漢", "、字", "Élan", "é", "é", "123", "4", ",", ".", "!?", "it's", " we'll", "<|endoftext|>", "<|", "|>", "Σ", "ΑΣ ", "a" * 40, "　", "\xa0", "don't.", "(x)", "̸=", "한국어 ", "ß"]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("long", [7, 50, 400])
def test_cut_texts_have_the_ids_of_whole_ones(path, long):
    rnd = random.Random(long)
    plain = ["the", " of", " and", "word", " x,", " 12", "\n", " new", ".", " it's"]
    texts = ["".join(rnd.choice(PARTS if i % 2 else plain) for _ in range(rnd.randrange(0, 400))) for i in range(120)] + ["", None, "a" * 3000, "漢" * 900, "1" * 2000]
    encoder = TextEncoder(path, long=long)
    ids, counts = encoder.ids(pa.array(texts))
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert np.array_equal(ids, np.concatenate(want))


def test_border():
    assert border("abc def ghi", 0, 8) == 7 and border("abc", 0, 8) == 3
    assert border("a" * 50 + " b", 0, 8) == 50 and border("x" * 30, 0, 8) == 30
    text = "漢字。" * 5000
    assert text[border(text, 0, 9000)] == "。"


MEASURE = """
import resource, sys
sys.path[:0] = [{root!r}, *{path!r}]
import pyarrow as pa
{setup}
text = {text}
arr = pa.array([text])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{work}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024 / (len(text.encode()) / 1e6))
"""
TEXTS = {"blanks": "' '.join('w%d' % (i * 7919 % 50021) for i in range(1_600_000))", "none": "'0123456789' * 1_000_000", "cjk": "'漢字文章是的。在有人' * 400_000"}


def growth(setup: str, work: str, text: str) -> float:
    """Megabytes of memory that a worker needs for each megabyte of one long text, beside the text."""
    code = MEASURE.format(root=ROOT, path=sys.path, setup=setup, work=work, text=text)
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout)


@pytest.mark.parametrize("kind", TEXTS)
def test_memory_of_the_encoder(kind):
    # ids are four bytes each; the bound for 10 MB of text is the caches and some copies of the ids
    grown = growth("from llm.tokens import TextEncoder", f"e = TextEncoder({PATHS[0]!r}); e.ids(arr)", TEXTS[kind])
    assert grown < 32, grown


def test_lines_longer_than_a_part(monkeypatch):
    """Hashes, signatures and sets of a line do not depend on the parts it is scanned in."""
    from llm import linededup as L

    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abc DEF é漢\t") for _ in range(n)) for n in (0, 1, 7, 8, 40, 300, 301, 1000, 2500)]
    texts = pa.array(["\n".join(lines), lines[-1], None, "", "\n".join(lines[::-1]) + "\n", " " * 900 + lines[5] + "\n" * 700])

    def scan():
        found, signed = [], {}
        for doc, number, line, check, own, table in L.LineScan(8, 12).texts(texts):
            found += zip(doc.tolist(), number.tolist(), line.tolist(), check.tolist(), strict=True)
            signed.update(zip(own.tolist(), map(tuple, table.tolist()), strict=True))
        return sorted(found), signed, [set(s.tolist()) for s in L.line_sets(pa.array([x.strip(L.WHITE_CHARS) for x in lines]))]

    want = scan()
    assert len({x[2:] for x in want[0]}) == len([x for x in lines if x.strip(L.WHITE_CHARS)])
    for part in (64, 400):
        monkeypatch.setattr(L, "PART", part)
        monkeypatch.setattr(L, "SLICE", part)
        assert scan() == want


@pytest.mark.parametrize("chunk", [3, 16, 1000])
def test_words_across_chunks(monkeypatch, chunk):
    from llm import hashing as H
    from llm.common import text_bytes

    rnd = random.Random(chunk)
    texts = pa.array(["".join(rnd.choice(["a", "B", " ", "é", "漢", "\n", "xyz" * 9]) for _ in range(rnd.randrange(60))) for _ in range(80)] + ["", None, "z" * 500])
    want = [x.tolist() for x in H.word_hashes(*text_bytes(texts), H.WHITE)]
    monkeypatch.setattr(H, "CHUNK", chunk)
    assert [x.tolist() for x in H.word_hashes(*text_bytes(texts), H.WHITE)] == want
    assert len(want[0]) == sum(len((t or "").split()) for t in texts.to_pylist())


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize("operator", ["words", "shingles", "lines"])
def test_memory_of_the_scans(kind, operator):
    setup, work, most = {
        "words": ("from llm.decontam import word_hashes", "word_hashes(arr)", 12),
        "shingles": ("from llm.neardup import shingle_sets", "shingle_sets(arr, 5)", 30),
        "lines": ("from llm.linededup import LineScan", "[len(x[0]) for x in LineScan(8, 56).texts(arr)]", 25),
    }[operator]
    grown = growth(setup, work, TEXTS[kind])
    assert grown < most, grown
