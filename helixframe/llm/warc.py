"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is a request, a response (or a revisit, if its payload is archived already) and a
metadata record; the request and the metadata name the response in WARC-Concurrent-To. The
assembly brings the records of a capture together through these identifiers and emits one
nested row per capture.

Archives are written by Spark's text writer: a record is a row, and the blank lines that
end a record are the line separator, so any file system Spark writes to will do, and a
failed task leaves nothing. They are read as whole files, record by record by their
Content-Length, so payloads may hold anything. Files are bounded in bytes: pages are written
by classes of payload size, each with as many captures a file as its largest payload allows,
so a file of several captures holds at most `file_bytes` of payloads.
Pages whose payload others share are found from digests alone, and only these keys are
joined to the pages: by a size-checked broadcast, so payloads aren't shuffled, or beyond
that by a shuffle that Spark can split where one payload fills much of the table.

Defined results: a null page has an empty payload; payloads of under `least` bytes are
never revisits; of rows with equal page_id, url and html, so many captures come back; a
null page_id is smaller than any other and comes back as null; a very long page is a file of
its own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, sized

FILE_BYTES = 64 << 20
#: Largest payload of a class, and how much larger that of the next is.
SMALL, STEP = 1 << 15, 8
END = "\r\n\r\n"


def _uri(role: str, page: Column, url: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(role), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    dashed = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: str, own: Column, block: Column, content: str, *headers: tuple[str, Column]) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: " + content)]
    for name, value in headers:
        lines += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def responders(pages: DataFrame, least: int = 1000) -> DataFrame:
    """For each payload that several pages share: its digest, size, and id and record of the
    page that answers for it."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.sha1(text).alias("digest"), F.octet_length(text).alias("n")).filter(F.col("n") >= least)
    groups = rows.groupBy("digest", "n").agg(F.max(F.struct("page_id", "url")).alias("answer"), F.count(F.lit(1)).alias("pages"))
    return groups.filter("pages > 1").select("digest", "n", F.col("answer.page_id").alias("answer"), _uri("response", F.col("answer.page_id"), F.col("answer.url"), F.col("digest")).alias("refers"))


def size_classes(most: int, file_bytes: int = FILE_BYTES) -> list[tuple[int, int, int]]:
    """(payloads of more than, payloads of up to, captures a file) for payloads up to `most`."""
    out, low, high = [], -1, min(SMALL, file_bytes)
    while True:
        out.append((low, high, max(1, file_bytes // high)))
        if high >= most:
            return out
        low, high = high, high * STEP


def write_warc(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Writes gzip'd archives to folders in `path`: three records per page, at most
    `file_bytes` of payloads in a file, or one capture."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    classes = size_classes(1 << 31, file_bytes)  # a string is shorter
    shared = sized(materialize(responders(pages, least), "warc-responders"))
    place = sum(((size > high).cast("int") for _, high, _ in classes), F.lit(0))
    present = {r["c"] for r in pages.select(place.alias("c")).distinct().collect()}  # as many as classes
    for c, (low, high, captures) in enumerate(classes):
        if c in present or not present and not c:
            own = pages.filter((size > low) & (size <= high)) if len(present) > 1 else pages
            _records(own, shared, least).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 3 * captures).text(f"{path}/size-{c}")


def _records(pages: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """value: the pages' records, without the blank lines that end them."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha1(text).alias("digest"), F.octet_length(text).alias("n"))
    rows = rows.join(shared, ["digest", "n"], "left")
    page, url, digest, refers = F.col("page_id"), F.col("url"), F.col("digest"), F.col("refers")
    target = F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\s\x00-\x1F]", "")
    own, labelled = _uri("response", page, url, digest), F.concat(F.lit("sha1:"), digest)
    revisits = refers.isNotNull() & ~F.col("answer").eqNullSafe(page)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    http = "application/http; msgtype=response"
    response = _record("response", own, F.concat(head, F.col("html")), http, ("WARC-Target-URI", target), ("WARC-Payload-Digest", labelled))
    revisit = _record(
        "revisit", own, head, http, ("WARC-Target-URI", target), ("WARC-Payload-Digest", labelled), ("WARC-Refers-To", refers),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    host = F.coalesce(F.regexp_extract(target, r"^\w+://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.regexp_replace(target, r"^\w+://[^/?#]*", ""), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _record("request", _uri("request", page, url, digest), asked, "application/http; msgtype=request", ("WARC-Target-URI", target), ("WARC-Concurrent-To", own))
    fields = F.concat(F.lit("pageId: "), F.coalesce(page.cast("string"), F.lit("-")), F.lit("\r\npayloadLength: "), F.col("n").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _uri("metadata", page, url, digest), fields, "application/warc-fields", ("WARC-Target-URI", target), ("WARC-Concurrent-To", own))
    return rows.select(F.explode(F.array(request, F.when(revisits, revisit).otherwise(response), metadata)).alias("value"))


RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def parse_warc(data: bytes):
    """Header and block of each record of a plain or gzip'd archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and last:
                header[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            header[last] = value.strip()
        n = int(header.get("content-length", 0))
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is shorter than its Content-Length")
        yield header, block


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record. Digest and size of a response's payload are taken from the payload
    itself; a revisit's digest from its header. `payloads`: return the payloads, too."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                held = 0
                for header, block in parse_warc(data.as_py()):
                    kind = header.get("warc-type", "")
                    row = {"record_id": header.get("warc-record-id"), "record_type": kind, "concurrent_to": header.get("warc-concurrent-to"), "refers_to": header.get("warc-refers-to"), "target_uri": header.get("warc-target-uri"), "date": header.get("warc-date"), "content_type": header.get("content-type")}
                    label = header.get("warc-payload-digest", "").partition(":")[2]
                    row["payload_digest"] = label.lower() or None
                    row["fields"] = None
                    body = block.partition(b"\r\n\r\n")[2] if header.get("content-type", "").startswith("application/http") else block
                    if kind == "response":
                        row |= {"payload_digest": hashlib.sha1(body).hexdigest(), "payload_bytes": len(body)}
                    elif kind == "metadata":
                        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
                        row["fields"] = [(a.strip(), b.strip()) for a, _, b in pairs]
                    row["payload"] = body if payloads and kind == "response" else None
                    rows.append(row)
                    held += len(block) if payloads else 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text = pa.string()
    schema = pa.schema([(c, text) for c in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "payload_digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(text, text)), ("payload", pa.binary())])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, n (equal captures), response, request and metadata as structs."""
    kind = F.col("record_type")
    main = kind.isin("response", "revisit", "resource")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    answer = F.struct("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")
    other = F.struct("record_id", "target_uri", "date")
    note = F.struct("record_id", F.map_entries("fields").alias("fields"))
    out = records.withColumn("capture_id", key).groupBy("capture_id").agg(
        F.count(F.when(main, True)).alias("n"), F.max(F.when(main, answer)).alias("response"), F.max(F.when(kind == "request", other)).alias("request"), F.max(F.when(kind == "metadata", note)).alias("metadata")
    )
    return out.withColumn("metadata", F.struct("metadata.record_id", F.map_from_entries("metadata.fields").alias("fields")))


def archived(pages: DataFrame, path: str | None = None, least: int = 1000) -> DataFrame:
    """Writes the pages to archives, reads these and returns page_id, payload_bytes,
    payload_digest, record_type, refers_to and url per capture."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/helixframe/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    rows = assemble(read_warc(spark, path)).filter("n > 0")
    page = F.col("metadata.fields")["pageId"].try_cast("long")
    rows = rows.select("capture_id", "n", page.alias("page_id"), F.col("metadata.fields")["payloadLength"].cast("long").alias("declared"), "response")
    rows = materialize(rows, "warc-captures")  # both sides of the join below, so archives are parsed once
    answers = rows.filter("response.record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"))
    # a capture that refers to none meets itself, so that such rows aren't one key
    rows = rows.join(answers, F.coalesce("response.refers_to", "capture_id") == F.col("refers"), "left")
    rows = rows.withColumn("refers_to", F.when(F.col("response.refers_to").isNotNull(), F.col("refers_to"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("page_id", F.coalesce("response.payload_bytes", "declared").alias("payload_bytes"), "response.payload_digest", "response.record_type", "refers_to", F.col("response.target_uri").alias("url"))
