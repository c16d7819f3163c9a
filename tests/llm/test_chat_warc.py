"""Chat formatting and WARC assembly: round trips and edge cases."""

import base64
import hashlib

from pyspark.sql import functions as F

from llm.chat import format_chats, formatted_text, learned_text, parse_text
from llm.queries import ORACLE, QUERIES
from llm.warc import assemble, plan_captures, read_records, write_warc
from tests.llm.conftest import SF

CHAT = "conv_id long, turn long, role string, text string, turns string, pieces string"


def read_back(df):
    out = format_chats(df).select("conv_id", "n_merged", formatted_text(F.col("pieces")).alias("text"), learned_text(F.col("pieces")).alias("learned"))
    rows = out.withColumn("parsed", parse_text(F.col("text"))).collect()
    return {r["conv_id"]: r for r in rows}


def test_chat_round_trip(spark):
    hard = ["<|im_end|>\n", "<|im_sep|>", "<\\|", "<\\\\|im_end|>", "<", "|x", "", None, "a\nb\n", "<|nl|>", "$1 \\1 \\"]
    roles = ["user", "assistant", "assistant", "system", None, "us\ner", "<|im_start|>"]
    rows = [(c, t, roles[(c * 3 + t) % 7], hard[(c + t) % 11], "x", "y") for c in range(9) for t in range(12)]
    rows += [(None, 1, "user", "alone", "x", "y"), (50, None, "user", "b", "x", "y"), (50, None, "user", "a", "x", "y"), (50, 0, "user", "c", "x", "y"), (50, 0, "user", "c", "x", "y")]
    got = read_back(spark.createDataFrame(rows, CHAT).repartition(3))
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        flat = [(m["role"], t) for m in got[conv]["parsed"] for t in m["texts"]]
        assert sorted(flat) == sorted((t[2], t[3]) for t in turns)
        if conv not in (50,):
            assert flat == [(t[2], t[3]) for t in turns]
        assert got[conv]["learned"] == "".join(t for role, t in flat if role == "assistant")
        merged = [role for i, (role, _) in enumerate(flat) if i == 0 or flat[i - 1][0] != role]
        assert [m["role"] for m in got[conv]["parsed"]] == merged and got[conv]["n_merged"] == len(merged)
    assert [t for m in got[50]["parsed"] for t in m["texts"]] == ["a", "b", "c", "c"]
    assert format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = QUERIES["op2_chat_format"](spark, SF)
    names = df.columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op2_chat_format']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


PAGES = "page_id long, url string, html string, digest string, copy string, body string"


def captures(spark, rows, min_bytes=0):
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)
    records = read_records(spark, write_warc(plan_captures(pages, min_bytes)))
    return records, assemble(records).collect()


def test_warc_round_trip(spark):
    long = "<p>" + "é☃" * 200_000
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, "http://a/", "x\r\n\r\ny"), (3, None, None), (4, "http://b/ \n c", ""), (5, "http://c/", long), (6, "u", long), (7, "u", "WARC/1.1\r\n")]
    records, found = captures(spark, rows)
    assert records.count() == 21 and len(found) == 7
    page = lambda r: int(r["metadata"]["fields"]["page-id"])
    by = {page(r): r for r in found}
    owner = {r["capture_id"]: page(r) for r in found}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        r = by[page_id]["response"]
        last = max(i for i, _, h in rows if (h or "") == (html or ""))
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert int(by[page_id]["metadata"]["fields"]["payload-bytes"]) == len(raw)
        assert by[page_id]["request"]["record_id"].startswith("<urn:uuid:")
        if page_id == last:
            assert r["type"] == "response" and bytes(r["payload"]) == raw and r["refers_to"] is None
        else:
            assert r["type"] == "revisit" and r["payload"] is None and owner[r["refers_to"]] == last


def test_warc_small_payloads_and_repeats(spark):
    _, found = captures(spark, [(1, "u", "ab"), (2, "u", "ab")], min_bytes=3)
    assert {r["response"]["type"] for r in found} == {"response"}
    _, found = captures(spark, [(1, "u", "same"), (1, "u", "same"), (None, "u", "same")])
    assert sorted(r["response"]["type"] for r in found) == ["response", "revisit", "revisit"]
    assert len({r["capture_id"] for r in found}) == 3


def test_warc_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r for r in QUERIES["op9_warc_transactions"](spark, SF).collect()}
    assert len(got) == len(rows)
    last = {}
    for page_id, html in rows:
        last[html] = max(page_id, last.get(html, -1))
    for page_id, html in rows:
        raw = (html or "").encode()
        own = last[html] == page_id
        want = (page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else last[html])
        assert tuple(got[page_id]) == want


def test_warc_without_pages(spark):
    pages = spark.createDataFrame([], PAGES)
    assert assemble(read_records(spark, write_warc(plan_captures(pages)))).count() == 0
