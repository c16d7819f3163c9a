"""WARC archives: every capture is a request, a response (or revisit) and a metadata record, tied together by
``WARC-Concurrent-To``; the reader joins the three and gives one nested row per capture.

Files hold one gzip member per record. A task writes under a name of its own attempt; only the names in the
manifest that Spark commits count. Record ids are UUIDs made from the page id and a row number among equal
page ids, so a repeated task writes the same records.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page id is a response
and the others are revisits that refer to it; smaller payloads are always responses.

Defined results: a null page text is the empty payload; a null url is the empty target; repeated rows of one
page id and payload are captures of their own, of which one is the response; a null page id is written as such and read
back as null, and is the smallest; an empty table gives no file; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import broadcast_if_small, fresh_dir, roomy, spread, stored
from llm.tokenfile import open_store

#: Fixed value: the date of all records, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, bytes long"
RECORDS = "warc_type string, record_id string, concurrent_to string, refers_to string, target string, payload_digest string, fields map<string,string>, payload_bytes long, payload binary"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def plan_captures(pages: DataFrame, min_bytes: int = 0, id_col="page_id", url_col="url", body_col="html") -> DataFrame:
    """``pages`` as page_id, copy, url, body, refers_page, refers_copy (null for responses)."""
    rows = spread(pages).select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8").alias("body"),
    ).withColumn("digest", F.sha1("body"))
    # most tables have unique page ids; else rows are numbered by their place in a stored table
    if rows.groupBy("page_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        rows = stored(rows).withColumn("copy", F.monotonically_increasing_id())
    order = F.struct("page_id", "copy")
    first = rows.filter(F.length("body") >= min_bytes).groupBy("digest").agg(F.max(order).alias("owner"), F.count("*").alias("n"))
    shared = first.filter("n > 1").select("digest", F.col("owner.page_id").alias("refers_page"), F.col("owner.copy").alias("refers_copy"))
    # few payloads are shared: their digests go to the pages, and no payload moves; else it is a shuffle join
    joined = rows.join(broadcast_if_small(stored(shared), 200_000), "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("refers_page")) & F.col("copy").eqNullSafe(F.col("refers_copy"))
    other = F.col("refers_copy").isNotNull() & ~own & (F.length("body") >= min_bytes)
    return joined.select("page_id", "copy", "url", "body", "digest", F.when(other, F.col("refers_page")).alias("refers_page"), F.when(other, F.col("refers_copy")).alias("refers_copy"))


def record_id(kind: str, page_id, copy) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{page_id}:{copy}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def clean_url(url: str) -> str:
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url)


def capture_records(page_id, copy, url, body, digest, refers_page, refers_copy) -> list[bytes]:
    """The request, the response or revisit and the metadata record of one capture."""
    target = [("WARC-Target-URI", clean_url(url))] if url else []
    main = record_id("response", page_id, copy)
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    base = [("WARC-Date", DATE), *target]
    ask = f"GET {clean_url(url) or '/'} HTTP/1.1\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    about = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(body)}\r\n".encode()
    digests = [("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_copy is None:
        shown = record([("WARC-Type", "response"), ("WARC-Record-ID", main), *base, *digests], http + body)
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        refers = ("WARC-Refers-To", record_id("response", refers_page, refers_copy))
        shown = record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *base, refers, profile, *digests], http)
    tied = ("WARC-Concurrent-To", main)
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, copy)), *base, tied, ("Content-Type", "application/http; msgtype=request")]
    notes = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, copy)), *base, tied, ("Content-Type", "application/warc-fields")]
    return [record(request, ask), shown, record(notes, about)]


def write_warc(captures: DataFrame) -> DataFrame:
    """Write the archives; gives the stored manifest, one row per file."""
    target = fresh_dir(captures.sparkSession, "warc")

    def work(batches):
        store, folder = open_store(target)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                for item in capture_records(*row):
                    out.write(item)
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{target}/{name}"], "n_records": [n], "bytes": [size]})

    return stored(captures.mapInArrow(roomy(work), MANIFEST))


def read_records(spark: SparkSession, manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """All records of the archives; ``payload`` is the body of a response, else null. A body that does not fit its digest fails."""
    paths = [r["path"] for r in manifest.select("path").collect()]
    jobs = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]

    def members(file):
        """The records of a file, one gzip member each, read piece by piece."""
        press, parts, data = zlib.decompressobj(31), [], b""
        while True:
            data = data or file.read(1 << 20)
            if not data:
                return
            parts.append(press.decompress(data))
            data = press.unused_data
            if press.eof:
                yield b"".join(parts)
                press, parts = zlib.decompressobj(31), []

    def parse(raw: bytes):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = rest[: int(fields["content-length"])]
        kind = fields["warc-type"]
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        more = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x] if kind == "metadata" else []
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if payload is not None and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {fields['warc-record-id']} is damaged")
        size = None if payload is None else len(payload)
        return kind, fields["warc-record-id"], fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, more, size, payload if with_payload else None

    def work(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, folder = open_store(folder)
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for raw in members(file):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return jobs.mapInArrow(roomy(work), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request and metadata structs, joined by concurrent-to.

    A capture whose request or metadata record is missing has null there.
    """
    main = records.filter(F.col("warc_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.struct(
            F.col("warc_type").alias("type"), "target", "payload_digest", "refers_to", "payload_bytes",
            "payload",
        ).alias("response"),
    )
    side = lambda kind, value: records.filter(F.col("warc_type") == kind).select(F.col("concurrent_to").alias("capture_id"), value.alias(kind))
    request = side("request", F.struct("record_id", "target"))
    notes = side("metadata", F.struct("record_id", "fields"))
    return main.join(request, "capture_id", "left").join(notes, "capture_id", "left")
