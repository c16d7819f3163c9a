import pytest
from pyspark.sql import functions as F

from nlsql_spark import constants as K
from nlsql_spark.functions import training as T
from nlsql_spark.operators import training_tables as TT
from nlsql_spark.operators.ordering import chunk, ordered_position
from nlsql_spark.operators.training_tables import build_vocab, encode, pad_batches, tokenized_dataset, words

S = "question_id long, prompt string, query string, reasoning_steps array<string>, question string"
BOS, EOS, UNK = (K.SPECIAL_TOKENS.index(t) for t in (K.BOS, K.EOS, K.UNK))


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, f"This is the {n} prompt", f"This is the {n} query", None, None) for i, n in enumerate(["first", "second", "third"])]
    rows.append((3, "P", "SELECT 1", ["s1", "s2"], "Q"))
    return spark.createDataFrame(rows, S)


def _texts(samples, make):
    return {r["question_id"]: r["t"] for r in samples.select("question_id", make.alias("t")).collect()}


def test_texts(samples):
    c = F.col
    train = _texts(samples, T.training_text(c("prompt"), c("question"), c("reasoning_steps"), c("query")))
    assert train[0] == "This is the first prompt This is the first query"
    assert train[3] == "[CONTEXT] P[QUESTION] Q\n[REASONING] s1 s2 [SQL] SELECT 1"
    ev = _texts(samples, T.evaluation_text(c("prompt"), c("question")))
    assert ev[1] == "This is the second prompt\nSELECT " and ev[3] == "[CONTEXT] P[QUESTION] Q\n[REASONING] "
    instruction, answer = T.instruction_pair(c("prompt"), c("question"), c("reasoning_steps"), c("query"))
    chat = _texts(samples, F.concat(T.chat_source(instruction), T.chat_answer(answer)))
    assert chat[0] == (
        "<|im_start|>user\nThis is the first prompt<|im_end|>\n<|im_start|>assistant\nThis is the first query\n<|im_end|>"
    )
    assert chat[3].endswith("assistant\n[REASONING] s1 s2 [SQL] SELECT 1\n<|im_end|>")
    instruction, answer = T.instruction_pair(c("prompt"), c("question"), mode="eval")
    assert _texts(samples, answer) == {0: "SELECT ", 1: "SELECT ", 2: "SELECT ", 3: "[REASONING] "}


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, "b a b [SQL]c"), (2, ""), (3, "zz b")], "question_id long, text string")
    vocab = build_vocab(df.filter("question_id < 3"))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    n = len(K.SPECIAL_TOKENS)
    assert {t: ids[t] for t in "abc"} == {"b": n, "a": n + 1, "c": n + 2}
    for limit in (1_000_000, 3):
        got = {r["question_id"]: r["ids"] for r in encode(df, vocab, ["question_id"], broadcast_words=limit).collect()}
        assert got == {1: [n, n + 1, n, ids["[SQL]"], n + 2], 2: [], 3: [UNK, n]}
    # a key may repeat: each row keeps its own words, whatever the size of the vocabulary
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (1, None)], "question_id long, text string")
    for limit in (1_000_000, 3):
        got = sorted(r["ids"] for r in encode(twice, vocab, ["question_id"], broadcast_words=limit).collect())
        assert got == sorted([[], [n + 2], [n + 1, n]])


def test_tokenized_datasets(spark, samples):
    vocab = build_vocab(samples.select(F.concat_ws(" ", "prompt", "query").alias("text")))
    word = {r["token"]: r["id"] for r in vocab.collect()}
    rows = lambda kind, mode: {r["question_id"]: r for r in tokenized_dataset(samples, vocab, kind, mode).collect()}
    train = rows("pretraining", "train")[0]
    text = "This is the first prompt This is the first query".split()
    assert train["input_ids"] == [BOS, *[word[w] for w in text], EOS] and train["attention_mask"] == [1] * 12
    assert rows("pretraining", "eval")[0]["input_ids"] == [BOS, *[word[w] for w in "This is the first prompt".split()], word.get("SELECT", UNK)]
    tuned = rows("instruction", "train")[0]
    source = [word["<|im_start|>"], UNK, *[word[w] for w in "This is the first prompt".split()], word["<|im_end|>"], word["<|im_start|>"], UNK]
    answer = [word[w] for w in "This is the first query".split()] + [word["<|im_end|>"]]
    assert tuned["input_ids"] == source + answer
    assert tuned["target_ids"] == [-100] * len(source) + answer
    assert len(rows("instruction", "eval")[0]["input_ids"]) == len(source) + 1
    probe = samples.select("question_id", F.col("prompt").alias("text"), F.lit(1).alias("label"))
    assert tokenized_dataset(probe, vocab, "probe").first()["input_ids"][0] == BOS


@pytest.mark.parametrize("side", ["right", "left"])
def test_padding(spark, side):
    rows = [(i, list(range(1, n + 1)), [1] * n) for i, n in enumerate([12, 5, 3])]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>, attention_mask array<int>")
    got = {r["id"]: r for r in pad_batches(df, ["id"], 2, 8, side).collect()}
    assert [len(got[i]["input_ids"]) for i in range(3)] == [16, 16, 8] and [got[i]["batch"] for i in range(3)] == [0, 0, 1]
    gap = [0] * 4
    assert got[0]["input_ids"] == (list(range(1, 13)) + gap if side == "right" else gap + list(range(1, 13)))
    mask = [-100] * 4
    assert got[0]["labels"] == (list(range(1, 13)) + mask if side == "right" else mask + list(range(1, 13)))
    assert {r["id"] for r in pad_batches(df, ["id"], 2, 8, side, drop_last=True).collect()} == {0, 1}


def test_array_columns(eval_col):
    ids = F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    ones = F.array(F.lit(1), F.lit(1), F.lit(0))
    assert eval_col(T.trim_input_ids(ids, ones)) == [3, 4]
    assert eval_col(T.mask_source_labels(ids, F.lit(2))) == [-100, -100, 3, 4]
    assert eval_col(T.mask_padded_labels(F.slice(ids, 1, 3), ones)) == [1, 2, -100]
    assert eval_col(T.last_attended(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ones)) == "b"
    assert eval_col(words(F.lit(" a[SQL]b \n c"))) == ["a", "[SQL]", "b", "c"]


@pytest.mark.parametrize("rows_per_range", [10_000, 70])
def test_ordered_position(spark, rows_per_range):
    # one key holds a third of the rows
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), (-F.col("id")).alias("o"))
    out = ordered_position(df, ["o"], name="p", rows_per_range=rows_per_range).collect()
    assert all(r["p"] == 999 - r["id"] for r in out) and len(out) == 1000
    keyed = ordered_position(df, ["o"], ["k"], rows_per_range=rows_per_range).collect()
    seen = {}
    for r in sorted(keyed, key=lambda r: r["o"]):
        assert r["position"] == seen.get(r["k"], 0)
        seen[r["k"]] = r["position"] + 1
    sizes = chunk(df, "id", 300, rows_per_range=rows_per_range).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in sizes) == [100, 300, 300, 300]


def test_words_are_cut_once(spark):
    """Special tokens stand alone wherever they touch a word; word lists that are given are not cut again."""
    rows = [(1, " a[SQL]b <|im_end|>[x <pad> \n[BACK][BACK]<c\t"), (2, ""), (3, None), (4, "[ < ["), (5, "plain x  y")]
    df = spark.createDataFrame(rows, "question_id long, text string").withColumn("w", TT.words(F.col("text")))
    got = {r["question_id"]: r["w"] for r in df.collect()}
    assert got[1] == ["a", "[SQL]", "b", "<|im_end|>", "[x", "<pad>", "[BACK]", "[BACK]", "<c"]
    assert got[2] == [] and got[3] is None and got[4] == ["[", "<", "["] and got[5][-1] == "y"
    vocab = TT.build_vocab(df.filter("question_id <> 4"))
    for most in (TT.BROADCAST_WORDS, 0):
        one = {r["question_id"]: r["ids"] for r in TT.encode(df, vocab, ["question_id"], broadcast_words=most).collect()}
        two = {r["question_id"]: r["ids"] for r in TT.encode(df.drop("text"), vocab, ["question_id"], broadcast_words=most, listed="w").collect()}
        assert one == two and one[3] == [] and len(one[1]) == 9


def test_instruction_ids_are_those_of_the_whole_text(spark, samples):
    vocab = TT.build_vocab(samples.select(F.concat_ws(" ", "prompt", "question", F.array_join("reasoning_steps", " "), "query").alias("text")))
    source, target = (f(x) for f, x in zip((T.chat_source, T.chat_answer), T.instruction_pair(*(F.col(c) for c in ("prompt", "question", "reasoning_steps", "query")))))
    whole = samples.select("question_id", F.concat(source, target).alias("text"), F.size(TT.words(source)).alias("n"))
    want = {r["question_id"]: (r["ids"], [-100] * min(r["n"], len(r["ids"])) + r["ids"][r["n"] :]) for r in TT.encode(whole, vocab, ["question_id"]).collect()}
    got = {r["question_id"]: (r["input_ids"], r["target_ids"]) for r in TT.tokenized_dataset(samples, vocab, "instruction").collect()}
    assert got == want and all(-100 in t for _, t in got.values())


def test_request_batches_are_spread(spark, monkeypatch):
    """Tasks grow with the batches; rows without a template are in no batch."""
    from nlsql_spark.operators import model_steps as M

    monkeypatch.setattr(M, "TASK_ROWS", 100)
    rows = spark.range(3000).selectExpr("id", "case when id < 2900 then 'hot' when id < 2990 then 'cold' end as prompt_template", "map('question', string(id)) as input_mappings")
    out = M.batch_by_template(rows, batch_size=50)
    # 58 and 2 batches of about 50 rows make 30 tasks of about 100
    assert "REPARTITION_BY_NUM" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "30)" in plan
    got = out.collect()
    assert sorted(i for r in got for i in r["ids"]) == list(range(2990)) and all(m["question"] == str(i) for r in got for i, m in zip(r["ids"], r["inputs"]))
    assert len({(r["prompt_template"], r["batch"]) for r in got}) == len(got) > 40 and max(len(r["ids"]) for r in got) < 100
    assert M.batch_by_template(rows.filter("id < 0")).collect() == []
