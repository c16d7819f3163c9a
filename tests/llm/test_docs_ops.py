"""Edge cases and brute force for the operators over documents."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.components import connected_components
from llm.decontam import drop_contaminated, find_contamination
from llm.langid import fit, features, identify, train
from llm.linededup import dedup_lines, lines_of, code_points
from llm.lsh import similar
from llm.neardup import drop_near_duplicates, near_duplicates
from llm.packing import best_fit, pack, token_pieces
from llm.quality import filter_quality
from llm.queries import QUERIES
from llm.repeats import GRAM, LENGTH, Family, remove_repeats, text_order
from llm.tokenfile import fetch_tokens, read_tokens, write_tokens
from llm.tokens import TextEncoder
from tests.llm.conftest import SF

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_text_encoder_equals_whole_texts(path, docs):
    texts = [*docs.values(), None, "", "a  b", " x", "x\n", "a\n\nb", "it's we'll I'M", "1234 5,6", "a　b", "<|endoftext|> a", "İ ǅ ß", "é x", "a\x1cb c", "a,.b ,. c"]
    encoder = TextEncoder(path, cache_bytes=12_000)
    ids, counts = encoder.ids(pa.array(texts))
    want = encoder.encode_whole([t or "" for t in texts])
    assert counts.tolist() == [len(w) for w in want]
    assert np.array_equal(ids, np.concatenate(want))


@pytest.mark.parametrize("path, text", [(WORD, "0123456789" * 110_000), (WORD, "7\n,\t" * 530_000), (BYTE, "7\n,\t" * 530_000)])
def test_text_encoder_on_a_long_text_without_blanks(path, text):
    encoder = TextEncoder(path)
    want = encoder.encode_whole(["before", text + "x", "after b"])
    assert len(want[1]) > 1 << 20
    for _ in range(2):  # the second time all pieces are known
        ids, counts = encoder.ids(pa.array(["before", text + "x", "after b"]))
        assert counts.tolist() == [len(w) for w in want]
        assert np.array_equal(ids, np.concatenate(want))


def test_token_files(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, SF).collect()}
    tokenizer, at = TextEncoder(WORD).tokenizer, 0
    for doc_id in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[doc_id]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_edges(spark, edge_docs, no_docs):
    manifest = write_tokens(edge_docs, WORD, 2)
    rows = sorted(map(tuple, read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11]
    assert [r[2] for r in rows[1:4]] == [1, 1, 1]
    fetched = {r["doc_id"]: r["ids"] for r in fetch_tokens(spark, manifest, spark.createDataFrame([(10,), (None,), (99,)], "doc_id long")).collect()}
    assert set(fetched) == {10, None} and fetched[10][-1] == 2
    assert read_tokens(spark, write_tokens(no_docs, WORD, 2)).count() == 0


def test_damaged_frame_fails(spark, edge_docs):
    manifest = write_tokens(edge_docs.filter("doc_id = 6"), WORD, 2)
    path = manifest.first()["path"].removeprefix("file:")
    with open(path, "r+b") as file:
        file.seek(4000)
        file.write(b"\x00\xff\x00")
    with pytest.raises(Exception, match="damaged|decompress|rror"):
        read_tokens(spark, manifest).collect()


def test_packing(spark, docs, edge_docs, no_docs):
    rows = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    tokenizer, want, total = TextEncoder(BYTE).tokenizer, set(), 0
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            size = (len(ids) - start) % 1024 or 1024
            want.add((doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start, piece = start + size, piece + 1
        total += len(ids)
    assert {tuple(r)[:5] for r in rows} == want
    check_bins(rows, 1024)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) * 1.05 + 2
    edge = pack(token_pieces(edge_docs, BYTE, 64, 2), 64).collect()
    check_bins(edge, 64)
    assert {r["doc_id"] for r in edge} == {None, *range(1, 12)}
    assert pack(token_pieces(no_docs, BYTE, 64, 2), 64).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_rounds_meet_across_partitions(spark):
    items = spark.createDataFrame([(i, 500 if i % 2 else 524) for i in range(64)], "item_id int, length long").repartition(16, "item_id")
    for local in (50_000, 4):  # one group, and sixteen of which the rounds must meet
        rows = pack(items, 1024, slack=0, local_items=local).collect()
        check_bins(rows, 1024)
        assert len({r["sequence_id"] for r in rows}) <= 40 and len(rows) == 64


def test_best_fit_is_exact():
    bin_of, offset, held = best_fit(np.array([600, 500, 424, 524, 1024]), 1024)
    assert sorted(held.tolist()) == [1024, 1024, 1024]


def test_language_model(spark, edge_docs, no_docs):
    out = identify(edge_docs, train(edge_docs, F.lit(True)))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == edge_docs.count() and set(edge_docs.columns) <= set(out.columns)
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[8]["lang_pred"] != "und"
    empty = train(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in identify(edge_docs, empty).collect()} == {"und"}
    assert identify(no_docs, empty).count() == 0
    one = fit(np.array(["en", "en"], object), features(pa.array(["the cat", "of and"])))
    assert one.predict(features(pa.array(["was"])))[0].tolist() == ["en"]


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF.replace("0.001", "0.01"))
    truth = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(truth, "doc_id").filter("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components_of(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_copies(n, seed=3):
    """Texts of which many differ from a base by a few words: stars, chains and unrelated ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, base = {}, [word() for _ in range(120)]
    now = list(base)
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(120)] = word()
        elif kind == 1:
            now[rnd.randrange(120)] = word()
            w = list(now)
        elif kind == 2:
            w = [word() for _ in range(rnd.randint(1, 60))]
        else:
            w = list(base[: rnd.randint(90, 120)])
        texts[i] = " ".join(w)
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = near_copies(240)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = components_of(sets, 85)
    got = {r["doc_id"]: r for r in near_duplicates(df, 3, 85, 32, 6).collect()}
    assert {i: got[i]["component_id"] for i in texts} == want
    assert {i: got[i]["n_shingles"] for i in texts} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr("llm.lsh.BLOCK", 3)
    texts = near_copies(60, seed=9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 3, 85, 40, 2).collect()}
    assert got == components_of({i: shingles(t, 3) for i, t in texts.items()}, 85)


def test_near_duplicates_edges(spark, edge_docs, no_docs):
    rows = near_duplicates(edge_docs, 5, 80).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 10)] == [0, 0, 0, 1]
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and by[None]["kept"] and by[1]["kept"]
    left = drop_near_duplicates(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([None, 1, 2, 3, 4, 4, 6, 8, 9, 10, 11])
    assert drop_near_duplicates(no_docs).count() == 0
    tied = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates(tied).collect()} == {1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_similar_counts_exactly():
    a, b = np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64)
    assert similar(a, b, (80, 100)) and not similar(a[:79], b, (80, 100)) and not similar(a[:0], a[:0], (80, 100))


def test_quality(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_rules"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = row["text"] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        hit = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[row["doc_id"]]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    out = filter_quality(edge_docs)
    assert out.count() == edge_docs.count() and not out.filter("doc_id = 1").first()["kept"]
    assert filter_quality(no_docs).count() == 0


def prose(rnd, n, common, letters):
    """Common words with falling frequency between rare words."""
    weights = [1 / (k + 1) for k in range(len(common))]
    rare = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9)))
    return " ".join(rnd.choices(common, weights)[0] if rnd.random() < 0.3 else rare() for _ in range(n))


def test_quality_verdicts_on_planted_texts(spark):
    rnd = random.Random(15)
    base = {"en": "the of and to in is that it was for on are with as be this", "de": "der die und in den von zu das mit sich des auf für ist im dem", "tl": "ang ng sa na mga at ay si ni kay para hindi ito may nang kung"}
    letters = "aaabcdeeeefghiiiklmnnooprrssttuvw"
    rows = [(100 * k + i, prose(rnd, rnd.choice([60, 150, 400]), words.split(), letters), lang) for k, (lang, words) in enumerate(base.items()) for i in range(60)]
    rows += [(1000 + i, prose(rnd, 200, base["tl"].split(), letters), None) for i in range(5)]
    rare = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9)))
    junk = [" ".join(rare() for _ in range(n)) for n in (60, 150, 400)]  # word salad
    junk += [", ".join(rare() for _ in range(n)) for n in (60, 150, 400)]  # keyword lists
    junk += [" ".join(rnd.choice(["ja", "nie", "tak", rare()]) for _ in range(200))]  # prose of a language without rows
    rows += [(2000 + i, x, lang) for i, x in enumerate(junk) for lang in ("en", None)]
    got = filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got if r["kept"] != (r["doc_id"] < 2000)] == []


def test_quality_of_many_languages(spark):
    rnd = random.Random(16)
    rows = []
    for k in range(70):
        # an alphabet and words of its own for each language; the last ones have the fewest words
        letters = [chr(0x4E00 + 40 * k + i) for i in range(30)] if k % 2 else [chr(0x400 + i) for i in range(60)] + list("0123456789"[: k // 7])
        common = ["".join(rnd.choice(letters[:30]) for _ in range(2)) + letters[0] for _ in range(16)]
        rows += [(k, prose(rnd, 400 - 4 * k, common, letters), f"lang{k:02}") for _ in range(2)]
    out = filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == 140 and all(r["word_distance"] < 0.2 and r["class_distance"] < 0.1 and r["kept"] for r in out)


def hits_of(text, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        w = find(body)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination(spark, docs, block_words):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "of the"), (901, ""), (902, None), (900, "zzz"), (None, "to in that")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = items[0][1] + " . " + items[1][1] + " " + items[0][1]
    extra = [(10_001, long), (10_002, "Of the OF The"), (10_003, None), (10_004, ""), (None, items[2][1]), (10_005, items[3][1]), (10_005, items[3][1]), (10_006, "xx to in that yy")]
    some = [(i, t) for i, t in docs.items() if i % 5 == 0] + extra
    df = spark.createDataFrame(some, "doc_id long, text string")
    rows = find_contamination(df, bench, block_words=block_words).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows)
    # an item without id hits words, and has no name
    assert got == Counter((i, n, h, tuple(f)) for i, t in some for n, h, f in [hits_of(t, items)])
    assert any(h and not f for _, t in some for _, h, f in [hits_of(t, items)])


def near_of(text, items, size=10, slop=2):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    words, near = find(text), set()
    for item, body in items:
        w = find(body)
        n = min(size, len(w))
        parts = [set(words[i : i + n + slop]) for i in range(max(1, len(words) - n - slop + 1))] if len(words) >= n else []
        if any(set(w[k : k + n]) <= part for k in range(len(w) - n + 1 if n else 0) for part in parts):
            near.add(str(item))
    return sorted(near - set(hits_of(text, items, size)[2]))


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_proximity_against_brute_force(spark, block_words):
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([2, 5, 9, 10, 11, 14, 25])))) for i in range(16)]
    texts = {}
    for i in range(150):
        w = rnd.choice(items)[1].split()[:14]
        for _ in range(rnd.randint(0, 4)):
            kind, at, other = rnd.randrange(3), rnd.randrange(len(w)), rnd.randrange(len(w))
            if kind == 0:
                w.insert(at, rnd.choice(["in", *vocabulary]))
            elif kind == 1:
                w[at], w[other] = w[other], w[at]
            elif len(w) > 2:
                del w[at]
        around = [[rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 20]))] for _ in range(2)]
        texts[i] = " ".join([*around[0], *w, *around[1]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: list(r["near_item_ids"]) for r in find_contamination(df, bench, block_words=block_words).collect()}
    want = {i: near_of(t, items) for i, t in texts.items()}
    assert sum(map(len, want.values())) > 50
    assert got == want


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven", "clash")], "item_id long, text string, tie string")
    left = drop_contaminated(edge_docs, bench)
    assert left.columns == edge_docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 6, 7, 8, 9, 10}
    assert drop_contaminated(edge_docs, bench.limit(0)).count() == edge_docs.count()
    assert find_contamination(no_docs, bench).count() == 0
    near = spark.createDataFrame([(1, "two three four five and six seven eight nine ten eleven"), (2, "x y")], "doc_id long, text string")
    row = find_contamination(near, bench).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["near_item_ids"]) for r in row] == [(0, ["1"]), (0, [])]


def line_sets(line, width=8):
    line = ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    return frozenset(line[i : i + width] for i in range(max(1, len(line) - width + 1)))


def test_fuzzy_lines_against_all_pairs(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(14)] for _ in range(6)]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            w = list(rnd.choice(base)) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(2, 14))]
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = word()
            lines.append(" " * rnd.randint(0, 2) + " ".join(w))
        texts[i] = "\n".join(lines)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    places = {(i, k): x for i, t in texts.items() for k, x in enumerate(t.split("\n")) if len(x.split()) >= 5}
    sets = {n: line_sets(x) for n, x in enumerate(places.values())}
    comp = components_of(sets, 80)
    first = {}
    for n, place in enumerate(places):
        first[comp[n]] = min(first.get(comp[n], place), place)
    gone = {place for n, place in enumerate(places) if first[comp[n]] != place}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    # more bands than usual: the comparison is with all pairs, at the very threshold too
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, bands=40, rows=3).collect()}
    assert got == want


def test_fuzzy_lines_of_all_lengths(spark):
    rnd = random.Random(12)
    word = lambda n, letters="abcdefghij": "".join(rnd.choice(letters) for _ in range(n))
    signs = [chr(c) for c in range(0x4E00, 0x4F00)] + [chr(c) for c in range(0xE01, 0xE2E)]
    pool = ["x", "X", "ab", "---", "seven77", "eight888", "}", "漢", "two words", "One, two three four", "  "]
    pool += [word(n) for n in range(1, 40, 3)] + [word(n, signs) for n in (3, 7, 8, 30, 90, 400)]
    pool += [" ".join(word(rnd.randint(1, 9)) for _ in range(n)) for n in (2, 3, 4, 5, 30)]
    # near copies far above the threshold, so that 14 bands of 4 propose them all but for one in 10^9
    pool += [x + "!" for x in pool if len(x) > 60] + ["ſ" + x for x in pool if len(x) > 60]
    texts = {i: "\n".join(rnd.choice([x, x.upper(), f" {x}\t", word(rnd.randint(1, 30))]) for x in rnd.choices(pool, k=rnd.randint(1, 6))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    places = {(i, k): x for i, t in texts.items() for k, x in enumerate(t.split("\n")) if x.strip(" \t")}
    sets = {n: line_sets(x) for n, x in enumerate(places.values())}
    comp = components_of(sets, 80)
    first = {}
    for n, place in enumerate(places):
        first[comp[n]] = min(first.get(comp[n], place), place)
    gone = {place for n, place in enumerate(places) if first[comp[n]] != place}
    assert sum(len(places[p].split()) < 5 for p in gone) > 50 and sum(len(places[p].strip()) < 8 for p in gone) > 20
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, bands=14, rows=4).collect()}
    assert got == want


def test_fuzzy_lines_edges(spark, edge_docs, no_docs):
    out = dedup_lines(edge_docs)
    assert out.columns == [*edge_docs.columns, "n_lines_removed"]
    rows = out.orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_docs.count() and by[1]["text"] is None and by[2]["text"] == ""
    # the null id comes first and keeps the line; the others lose it
    assert by[None]["n_lines_removed"] == 0 and by[4]["text"] == by[5]["text"] == "" and by[4]["n_chars"] == 0
    assert by[11]["text"] == "short" and by[11]["n_lines_removed"] == 3
    assert by[6]["n_lines_removed"] == 0 and by[7]["text"] == ""
    assert dedup_lines(no_docs).count() == 0


def test_lines_of_texts():
    codes, offsets = code_points(pa.array(["a b\n\n c \n", "", None, "x"]))
    doc, number, start, end, words = lines_of(codes, offsets)
    assert list(zip(doc.tolist(), number.tolist(), (end - start).tolist(), words.tolist(), strict=True)) == [
        (0, 0, 3, 2), (0, 1, 0, 0), (0, 2, 1, 1), (0, 3, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 1, 1)
    ]


def repeats_of(docs, size=50):
    first, out = {}, {}
    for i, text in sorted(docs.items()):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if first.setdefault(raw[p : p + size], i) < i:
                cut[p : p + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(cut)))
        out[i] = (len(raw), sum(cut), runs, hashlib.sha256(bytes(x for x, c in zip(raw, cut, strict=True) if not c)).hexdigest())
    return out


def test_repeated_bytes(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op8_repeated_bytes"](spark, SF).collect()}
    assert got == repeats_of(docs)


def test_repeated_bytes_planted(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 400)))
    shared = [word() for _ in range(8)]
    texts = {i: "".join(rnd.choice([word(), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 60) :], "ab" * 60]) for _ in range(rnd.randint(0, 5))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in remove_repeats(df).collect()}
    assert got == repeats_of(texts)


def windows_of(row, length=6, reach=3):
    """The windows of a segment row: by offset, the bytes before and behind the anchor."""
    before, behind = int(row[-2]), int(row[-1])
    return {o: (bytes(row[length : length + o]), bytes(row[: length - o])) for o in range(reach + 1) if o <= before and length - o <= behind}


def test_family_of_suffix_arrays():
    """Segments of few bytes (zeros too), documents in several parts, batches of all sizes, against all pairs."""
    rnd = random.Random(6)
    rows, refs = [], []
    for n in range(700):
        before, behind = rnd.randint(0, 3), rnd.randint(3, 6)
        right = [rnd.choice([0, 1, 1, 200]) for _ in range(behind)]
        left = [rnd.choice([0, 1, 2]) for _ in range(before)]
        rows.append(right + [0] * (6 - behind) + left + [0] * (3 - before) + [before, behind])
        refs.append((rnd.randrange(9), rnd.randrange(4), n))
    rows = np.array(rows, np.uint8)
    least = {}
    for row, (d, _, _) in zip(rows, refs):
        for window in windows_of(row).items():
            least[window] = min(d, least.get(window, d))
    want = {(p, r): sum(1 << o for o, w in windows_of(row).items() if least[o, w] < d) for row, (d, p, r) in zip(rows, refs)}
    for batch_entries in (1, 3, 50, 10_000):
        order = rnd.sample(range(700), 700)
        family = Family(6, 3, batch_entries)
        for at in range(0, 700, 7):
            some = order[at : at + 7]
            d, p, r = (np.array(c) for c in zip(*(refs[i] for i in some)))
            family.add(rows[some], d, p, r)
            # every level is in the order of its bytes, each segment once, and levels shrink
            for level in family.levels:
                keys = [bytes(k) for k in level.columns[0].view(np.uint8).reshape(len(level), -1)]
                assert keys == sorted(set(keys))
            sizes = [len(level) for level in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        part, found = family.close()
        got = dict.fromkeys(want, 0)
        for p, (r, m) in zip(part.tolist(), found.tolist()):
            got[p, r] |= m & sum(1 << o for o in windows_of(rows[r]))
        assert got == want


def test_text_order_keeps_zero_bytes():
    rows = np.array([[1, 0, 0, 2], [1, 0, 0, 1], [0, 0, 0, 3]], np.uint8)
    assert np.argsort(text_order(rows)).tolist() == [2, 1, 0] and text_order(rows)[0] != text_order(rows)[1]


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """All hashes are one number: anchors are window starts, one share gets all, and bytes alone decide."""
    from llm import repeats

    monkeypatch.setattr(repeats, "mix", lambda x: x * np.uint64(0))
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(200)
    texts = {i: word(60) + (shared[rnd.randint(0, 90) : rnd.randint(100, 200)] if i % 3 == 0 else "") + word(70) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in remove_repeats(df).collect()}
    want = repeats_of(texts)
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_repeated_rows_in_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(Family.__init__, "__defaults__", (LENGTH, GRAM, 5))
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = [word(400) for _ in range(6)]
    texts = {i: "".join(rnd.choice([word(80), rnd.choice(shared)[rnd.randint(0, 90) : rnd.randint(200, 400)]]) for _ in range(rnd.randint(1, 5))) for i in range(24)}
    # every row stands in three partitions
    rows = [(i, t, p) for p in range(3) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, p int").repartitionByRange(3, "p").select("doc_id", "text")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in remove_repeats(df).collect()]
    assert Counter(got) == Counter({(i, *x): 3 for i, x in repeats_of(texts).items()})


def test_repeated_bytes_edges(spark, edge_docs, no_docs):
    rows = remove_repeats(edge_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_docs.count() and by[1]["n_bytes"] == 0 and by[None]["n_removed"] == by[4]["n_removed"] == by[6]["n_removed"] == 0
    assert by[5]["n_removed"] == by[5]["n_bytes"] and by[7]["n_removed"] == by[7]["n_bytes"]
    assert remove_repeats(no_docs).count() == 0


def components_by_hand(pairs):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    return {x: find(x) for x in lead}


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    from llm import components

    written = []
    monkeypatch.setattr(components, "stored", lambda df, f=components.stored: written.append(1) or f(df))
    rows = np.random.default_rng(3).integers(-400, 400, (500, 2)).tolist() + [[i, i + 1] for i in range(1000, 1050)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == components_by_hand(rows) and len(written) == 3


def test_components_of_many_tasks_and_windows(spark, monkeypatch):
    from llm import components

    monkeypatch.setattr(components, "TASK_EDGES", 40)
    rows = np.random.default_rng(4).integers(0, 500, (400, 2)).tolist() + [[i, i + 1] for i in range(1000, 1050)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = connected_components(edges).collect()
    assert {r["node"]: r["component"] for r in got} == components_by_hand(rows) and len(got) == len(components_by_hand(rows))


def test_equal_lines_of_windows_settle_in_their_share():
    from llm.linededup import LINE, SETTLED_NAMES, settle_shares

    rows = [(5, 9, 3, 1, 0, 1), (5, 9, None, 1, 4, 2), (5, 8, 1, 1, 0, 0), (5, 9, None, 1, 4, 0), (5, 9, None, 1, 5, 0), (6, 9, 2, 2, 7, 1)]
    names = ["kind", "share", "keys", "nodes", "flags", *LINE]

    def batch(some):
        n = len(some)
        own = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), list(LINE.values())[:-1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(["line"] * n), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3, *own, pa.nulls(n, pa.string())], names)

    got = pa.Table.from_batches(list(settle_shares(iter([batch(rows[:3]), batch(rows[3:])])))).to_pylist()
    assert list(got[0]) == SETTLED_NAMES and len(got) == 6
    by = lambda kind: {(r["line"], r["check"], r["doc_id"], r["number"], r["part"]) for r in got if r["kind"] == kind}
    assert by("line") == {(5, 9, None, 4, 0), (5, 9, None, 4, 2), (5, 8, 1, 0, 0), (6, 9, 2, 7, 1)}
    assert by("gone") == {(5, 9, 3, 0, 1), (5, 9, None, 5, 0)}


def test_training_holds_one_copy_of_the_sample():
    import tracemalloc

    x = np.random.default_rng(5).random((1200, 4096), np.float32)
    lang = np.array(["en", "fr"] * 600, object)
    from llm.langid import fixed_order

    order = fixed_order(lang, x)
    lang, x = lang[order], x[order]
    tracemalloc.start()
    fit(lang, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes
