"""The splittable JSON array reader against the json module, over ranges of a few bytes; the parallel writer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nlsql_spark.sources import files as S
from nlsql_spark.sources import json_array as J


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of the given size."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


def made(rnd, depth=0):
    kind = rnd.randrange(9 if depth < 3 else 5)
    if kind < 2:
        return "".join(rnd.choice(['"', "\\", "}", "{", "[", "]", ",", " ", "a", "é", "漢", "\n", '\\"', "\\\\"]) for _ in range(rnd.randrange(12)))
    if kind < 5:
        return rnd.choice([None, True, 12, -3, 0])
    if kind < 7:
        return {f"k{i}": made(rnd, depth + 1) for i in range(rnd.randrange(4))}
    return [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def read(spark, path):
    """The elements by place, objects and arrays parsed again."""
    rows = sorted((r["pos"], r["entry"]) for r in J.array_elements(spark, path).collect())
    assert [p for p, _ in rows] == list(range(len(rows)))
    return [e for _, e in rows]


def plain(spark, path):
    """The same by parsing the file as one value."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("e")).first()
    return row["e"]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("size", [16, 97, 1 << 20])
def test_random_arrays(spark, tmp_path, small_ranges, seed, size):
    rnd = random.Random(seed)
    value = [made(rnd) if seed % 2 else {"id": i, "x": made(rnd)} for i in range(rnd.randrange(1, 40))]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(value, indent=rnd.choice([None, 1, 4]), ensure_ascii=rnd.random() < 0.5), encoding="utf-8")
    small_ranges(size)
    got = read(spark, str(path))
    assert got == plain(spark, str(path))
    for have, want in zip(got, value):
        if isinstance(want, (dict, list)):
            assert json.loads(have) == want


def test_many_tasks_and_elements_longer_than_a_range(spark, tmp_path, small_ranges):
    value = [{"id": i, "text": "x{]" * (i % 7) * 300} for i in range(500)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(value))
    small_ranges(4000)
    assert J.ranges_of(spark, str(path)).rdd.getNumPartitions() > 50
    assert [json.loads(e) for e in read(spark, str(path))] == value


def test_empty_and_several_files(spark, tmp_path, small_ranges):
    texts = ["[]", " [ \n ] ", "[{}]", '[{"a":1}, {"b":[1,2]}]\n', "[1, 2, 3]", '["}"]', "[[],[]]"]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.json").write_text(text)
    small_ranges(8)
    assert read(spark, str(tmp_path / "f0.json")) == read(spark, str(tmp_path / "f1.json")) == []
    # ids go on from file to file
    assert read(spark, str(tmp_path)) == ["{}", '{"a":1}', '{"b":[1,2]}', "1", "2", "3", "}", "[]", "[]"]


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', "[1, 2]]", '["open]', "1", ""])
def test_broken_files_fail(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    if not text:
        assert read(spark, str(path)) == []
        return
    with pytest.raises(ValueError, match="not a whole JSON array"):
        J.array_elements(spark, str(path))


def test_questions_of_several_files(spark, tmp_path):
    entry = {"db_id": "d", "question": "q", "evidence": "", "SQL": "select 1"}
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps([dict(entry, question=f"{name}{i}") for i in range(3)]))
    rows = S.read_questions(spark, str(tmp_path), limit=4).orderBy("question_id").collect()
    assert [(r["question_id"], r["question"]) for r in rows] == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_parallel_writer(spark, tmp_path, n, request):
    # small partitions are not to be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    folder = str(tmp_path / "out")
    entry = F.to_json(F.struct("id", F.lit('a"},{\n').alias("x")))
    for _ in range(2):  # written again: the manifest names the new parts
        J.write_json_array(spark.range(n).repartition(7).select("id", entry.alias("entry")), folder, ["id"])
    parts = J.array_parts(spark, folder)
    joined = "".join(open(p.removeprefix("file:").replace("///", "/")).read() for p in parts)
    assert [e["id"] for e in json.loads(joined)] == list(range(n))
    assert n < 1000 or len(parts) > 1
    back = sorted((r["pos"], json.loads(r["entry"])["id"]) for r in J.read_written_array(spark, folder).collect())
    assert back == [(i, i) for i in range(n)]
