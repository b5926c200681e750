"""WARC archives as Spark tables: segmented records written and read as (record, chunk number) rows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm._shared import written

CRLF2 = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CHUNKS = "file string, record_id string, warc_type string, target_uri string, refers_to string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1, the form of WARC-Payload-Digest: ten hex digits are eight base-32 digits."""
    digest = F.sha1(data)
    out = []
    for part in range(4):
        bits = F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def record_name(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def archive_plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Per page: id, url, body (UTF-8 bytes), digest, first (the response's id if this page revisits it, else null).

    Of pages with equal payloads the smallest id is the response, if the payload has revisit_bytes or more; payloads
    are equal if their SHA-1, their lengths and a second hash are. These are grouped apart from the payloads, with a
    map-side combine. Rows that repeat a page_id with other payloads are pages of their own; with the same payload,
    if that id is the smallest, each is a response.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), body.alias("body"))
    base = base.withColumns({"digest": base32_sha1(F.col("body")), "size": F.octet_length("body").cast("long"), "mark": F.xxhash64("body")})
    key = ["digest", "size", "mark"]
    first = base.where(F.col("size") >= revisit_bytes).groupBy(*key).agg(F.min("id").alias("first"))
    out = base.join(written(first, "firsts"), key, "left").drop("mark")
    return out.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")))


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = 1 << 18, revisit_bytes: int = 0, **columns: str) -> None:
    """Writes one WARC/1.1 record per page to gzip files under path, one file per task, by Spark's own writer.

    A payload of over chunk_bytes becomes segments (WARC-Segment-Number, continuation records, in order in one
    file), so no record is built whole; each segment is a row of text, and the record separator is the writer's
    line separator. The payload stays the bytes of the html. Gzip keeps a file in one reading task.

    Defined cases: null html is an empty payload; null url is urn:none; line breaks in a url become spaces; a page
    with null page_id is written as urn:page:none and never is the response of another page.
    """
    plan = archive_plan(pages, revisit_bytes=revisit_bytes, **columns)
    plan = plan.withColumn("revisit", F.col("first").isNotNull())
    last = F.when(F.col("revisit") | (F.col("size") == 0), F.lit(0)).otherwise(F.floor((F.col("size") - 1) / chunk_bytes))
    rows = plan.withColumn("segments", last + 1).withColumn("seg", F.explode(F.sequence(F.lit(1).cast("long"), F.col("segments"))))
    chunk = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring("body", ((F.col("seg") - 1) * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(CRLF2))
    http = F.when(F.col("seg") == 1, http).otherwise("")
    kind = F.when(F.col("revisit"), "revisit").when(F.col("seg") > 1, "continuation").otherwise("response")
    name = record_name(F.col("id"))
    line = lambda label, value: F.concat(F.lit(f"\r\n{label}: "), value)
    some = lambda when, value: F.when(when, value).otherwise("")
    many = F.col("segments") > 1
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        line("WARC-Record-ID", F.concat(F.lit("<"), name, F.when(F.col("seg") > 1, F.concat(F.lit(":segment:"), F.col("seg").cast("string"))).otherwise(""), F.lit(">"))),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z"),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit("urn:none"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        some(F.col("revisit"), line("WARC-Refers-To", F.concat(F.lit("<"), record_name(F.col("first")), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        some(many, line("WARC-Segment-Number", F.col("seg").cast("string"))),
        some(F.col("seg") > 1, line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), name, F.lit(">")))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length("http") + F.octet_length("chunk")).cast("string")),
    )
    rows = rows.withColumn("http", http).withColumn("chunk", chunk)
    text = F.concat(header, F.lit(CRLF2), F.col("http"), F.col("chunk").cast("string"))
    rows.select(text.alias("value")).write.option("lineSep", CRLF2).option("compression", "gzip").text(path)


class _Record:
    """What is known of the record under way: its digest so far, never its payload."""

    def __init__(self, head: dict[str, str]):
        self.head, self.sha, self.size, self.chunks, self.http = head, hashlib.sha1(), 0, 0, head["warc-type"] in ("response", "revisit")


def _parse(stream: Iterator[tuple[str, bytes]], keep: bool) -> Iterator[tuple]:
    """Rows of CHUNKS from (file, bytes) in order. A row is emitted one piece behind, to know the last."""
    state: dict = {"file": None}

    def row(last: bool) -> tuple:
        r, head = state["record"], state["record"].head
        digest = base64.b32encode(r.sha.digest()).decode() if head["warc-type"] != "revisit" else head.get("warc-payload-digest", "").removeprefix("sha1:")
        return (state["file"], head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to", "<>").strip("<>") or None, r.chunks, state["held"] if keep else None, r.size, digest, last)

    def end() -> Iterator[tuple]:
        if state.get("record"):
            yield row(True)
        state.update(record=None, held=b"", buffer=bytearray(), need=None)

    def body(data: bytes) -> Iterator[tuple]:
        r = state["record"]
        if data:
            if state["held"]:
                yield row(False)
                r.chunks += 1
            r.sha.update(data)
            r.size += len(data)
            state["held"] = data

    for file, data in stream:
        if file != state["file"]:
            yield from end()
            state["file"] = file
        buf = state["buffer"]
        buf += data
        while True:
            if state["need"] is None:  # a header, after the blank lines that end the record before
                while buf[:2] == b"\r\n":
                    del buf[:2]
                at = buf.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buf[:at].decode("utf-8", "replace").split("\r\n")[1:])}
                del buf[: at + 4]
                if head.get("warc-type") == "continuation" and state["record"] and head.get("warc-segment-origin-id") == state["record"].head["warc-record-id"]:
                    pass
                else:
                    held = state["buffer"]
                    yield from end()
                    state["buffer"] = buf = held
                    state["record"] = _Record(head)
                state["need"] = int(head["content-length"])
            r = state["record"]
            if r.http:
                at = buf.find(b"\r\n\r\n", 0, state["need"])
                if at < 0:
                    break
                state["need"] -= at + 4
                del buf[: at + 4]
                r.http = False
            take = min(len(buf), state["need"])
            yield from body(bytes(buf[:take]))
            del buf[:take]
            state["need"] -= take
            if state["need"]:
                break
            state["need"] = None
    yield from end()


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives under path: one row per (record_id, chunk_no), in columns CHUNKS.

    Files stream through the parser piece by piece: a piece is at most one segment, and payload_bytes and
    payload_digest are those of the payload up to and including the row's chunk, so that the row with last holds
    the whole record's. payloads=False leaves the chunks themselves out (their digests are still computed).
    A revisit has no payload; its digest is the one its header states, and refers_to names the response.
    """
    lines = spark.read.option("lineSep", CRLF2).text(path).select(F.col("_metadata.file_path").alias("f"), F.col("value").cast("binary").alias("v"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for f, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield f, v.as_py() + b"\r\n\r\n"

        rows, held = [], 0
        for row in _parse(stream(), payloads):
            rows.append(row)
            held += len(row[6] or b"")
            if len(rows) >= 2000 or held > 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return lines.mapInArrow(parse, CHUNKS)


_SCHEMA = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def index_of(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: record_id, target_uri, warc_type, refers_to, payload_bytes, payload_digest.

    A revisit takes payload_bytes from the response it refers to: the record of that name and of the revisit's digest,
    so that names which repeat (as repeated page_ids do) don't mix.
    """
    full = chunks.where("last").select("record_id", "target_uri", "warc_type", "refers_to", "payload_bytes", "payload_digest")
    sizes = full.where("warc_type = 'response'").groupBy(F.col("record_id").alias("origin"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("origin_bytes"))
    out = full.join(sizes, (full["refers_to"] == sizes["origin"]) & (full["payload_digest"] == sizes["of"]), "left")
    return out.withColumn("payload_bytes", F.coalesce("origin_bytes", "payload_bytes")).drop("origin", "of", "origin_bytes")
