"""WARC archives: captures as request, response and metadata records, written and assembled again.

``write_archives`` makes three records of every page; ``read_records`` parses archives record by
record, by their stated lengths, whatever stands in a payload; ``captures`` joins the records of a
transaction through their concurrent-to identifiers.  Only identifiers and headers are joined,
payloads just if they are asked for.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, removed, shared_dir, small_batches, table

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Records of one archive file; three make a capture.
FILE_RECORDS = 30_000
#: Records that the parser gives back at once, and bytes of payloads.
OUT_ROWS, OUT_BYTES = 2_000, 4 << 20
# What a record and a line of its header end with, and the names of the profile.
RECORD_END, LINE_END = "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()),
    ("stated_digest", pa.string()), ("refers_to_uri", pa.string()), ("http", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()),
])


# ---- writing ---------------------------------------------------------------------------------


def first_captures(pages: DataFrame) -> DataFrame:
    """(digest, first_id, first_url) of payloads that several rows have: the smallest page_id and its URL."""
    rows = _payloads(pages).where(F.col("size") >= LEAST_REVISIT)
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    return first.where("n > 1 AND first.page_id IS NOT NULL").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


def _payloads(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})


def _uri(url: Column) -> Column:
    """A URL for a header line: blanks and control characters escaped; the exact one is in the metadata."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]+", "%20")


def _record(kind: Column | str, ident: Column, url: Column, date: str, fields: list[tuple[str, Column]], content: str, size: Column, *block: Column) -> Column:
    """A record without its end; a field whose value is null is left out."""
    named = [("WARC-Type", kind if isinstance(kind, Column) else F.lit(kind)), ("WARC-Record-ID", _urn(ident)), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _uri(url)), *fields, ("Content-Type", F.lit(content)), ("Content-Length", size.cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE_END)), F.lit("")) for name, value in named]
    return F.concat(F.lit(f"WARC/1.1{LINE_END}"), *lines, F.lit(LINE_END), *block)


def _urn(ident: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), ident, F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a response or revisit, a request and a metadata record of each row into packed archives at ``path``.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are
    responses, the others revisits without payload.  Null page_ids come last.  A row that is
    repeated makes as many captures.  Identifiers are unique, and are made where a row is written.
    The table of repeated payloads is stored first; Spark broadcasts it if its stored size is small
    enough for that, else payloads are dealt by digest, and large groups of copies are split.
    """
    scratch = Scratch()
    first = scratch.written(first_captures(pages), "first-captures")
    rows = _payloads(pages).join(first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE_END}Content-Type: text/html; charset=utf-8{LINE_END}Content-Length: "), F.col("size").cast("string"), F.lit(RECORD_END))
    host, file = (F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(d)), r"[\x00-\x20\x7f]", "") for p, d in (("HOST", ""), ("FILE", "/")))
    asked = F.concat(F.lit("GET "), file, F.lit(f" HTTP/1.1{LINE_END}Host: "), host, F.lit(RECORD_END))
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{LINE_END}page-url: "), F.to_json(F.array("url"), {"ignoreNullFields": "false"}), F.lit(LINE_END))
    rows = rows.select(
        "url", "html", "size", "digest", "first_url", again.alias("again"), head.alias("head"), asked.alias("asked"), notes.alias("notes"),
        F.expr("uuid()").alias("main"), F.expr("uuid()").alias("request"), F.expr("uuid()").alias("metadata"),
    )
    c, u = F.col, F.col("url")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("digest")))
    seen = [("WARC-Profile", F.when(c("again"), PROFILE)), ("WARC-Refers-To-Target-URI", F.when(c("again"), _uri(c("first_url"))))]
    body = F.when(c("again"), "").otherwise(c("html"))
    size = F.octet_length("head") + F.when(c("again"), F.lit(0).cast("long")).otherwise(c("size"))
    with_ = [("WARC-Concurrent-To", _urn(c("main")))]
    records = F.array(
        _record(F.when(c("again"), "revisit").otherwise("response"), c("main"), u, date, [digest, *seen], "application/http; msgtype=response", size, c("head"), body),
        _record("request", c("request"), u, date, with_, "application/http; msgtype=request", F.octet_length("asked"), c("asked")),
        _record("metadata", c("metadata"), u, date, with_, "application/warc-fields", F.octet_length("notes"), c("notes")),
    )
    writer = rows.select(F.explode(records).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    writer.text(path)
    scratch.drop()


# ---- reading ---------------------------------------------------------------------------------

_FIELD = re.compile(rb"([^:\s]+)\s*:\s*(.*?)\s*$", re.S)


class BrokenArchive(ValueError):
    """An archive ends within a record, or a record isn't as long as it says."""


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names in lower case and values; a line that begins with a blank goes on with the last one."""
    out: list[tuple[str, str]] = []
    for line in lines:
        found = _FIELD.match(line)
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif found:
            out.append((found[1].decode("utf-8", "replace").lower(), found[2].decode("utf-8", "replace")))
    return out


def split_records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of the records in ``lines``, which are (file, line) in order; one record is in memory."""
    head: list[bytes] | None = None
    block: list[bytes] | None = None
    fields: list[tuple[str, str]] = []
    held = want = 0
    last = None
    for file, line in lines:
        if file != last:
            if head is not None:
                raise BrokenArchive("an archive ends within a record")
            last = file
        if head is None:
            if line.startswith(b"WARC/"):
                head = []
            elif line:
                raise BrokenArchive(f"no record begins with {line[:40]!r}")
        elif block is None:
            if line:
                head.append(line)
                continue
            fields = _fields(head)
            want, held, block = int(dict(fields).get("content-length", "-1")), -2, []
            if want < 0:
                raise BrokenArchive("a record has no length")
        else:
            block.append(line)
            held += len(line) + 2
            if held > want:
                raise BrokenArchive(f"a record of {want} bytes has more")
            if held == want:
                yield fields, b"\r\n".join(block)
                head = block = None
    if head is not None:
        raise BrokenArchive("an archive ends within a record")


def _parsed(fields: list[tuple[str, str]], block: bytes, with_payload: bool) -> tuple:
    named = dict(fields)
    ident = lambda v: v.strip("<>").removeprefix("urn:uuid:")
    kind, content = named.get("warc-type"), named.get("content-type", "")
    http, notes, payload = None, None, block
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    elif content.startswith("application/warc-fields"):
        notes = list(dict(_fields(block.split(b"\r\n"))).items())
    stated = named.get("warc-payload-digest")
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else None
    algorithm, _, value = (stated or "").partition(":")
    intact = value.lower() == digest if digest and algorithm == "sha256" else None
    row = (
        ident(named.get("warc-record-id", "")), kind, [ident(v) for n, v in fields if n == "warc-concurrent-to"], named.get("warc-target-uri"), named.get("warc-date"),
        value.lower() if algorithm == "sha256" else None, named.get("warc-refers-to-target-uri"), http, notes, len(payload), digest, intact,
    )
    return (*row, payload) if with_payload else row


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of packed archives, in files of any size; with ``with_payload``, their blocks without HTTP headers too.

    ``intact`` tells whether a response's payload has the digest that its header states (null if
    it states none of SHA-256).  An archive that is cut off, or a record of another length than it
    says, raises.  A file is read by one task in order, so archives have to be packed (Spark would
    cut plain ones); an empty folder has no records.
    """
    schema = RECORD.append(pa.field("payload", pa.binary())) if with_payload else RECORD

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            if max(batch.column(1).to_pylist(), default=0):
                raise BrokenArchive("an archive that isn't packed can't be read in order")
            yield from zip(batch.column(0).to_pylist(), (x or b"" for x in batch.column(2).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for fields, block in split_records(lines(batches)):
            rows.append(_parsed(fields, block, with_payload))
            size += len(block) if with_payload else 0
            if len(rows) >= OUT_ROWS or size > OUT_BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    text = spark.read.schema("value string").option("lineSep", LINE_END).text(path)
    numbered = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return small_batches(numbered).mapInArrow(run, from_arrow_schema(schema))


# ---- assembly --------------------------------------------------------------------------------


def transaction_links(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): the capture of each request and metadata record.

    A record names the response or revisit, or is named by it, or names a request that is so linked.
    A record with several captures belongs to the nearest, of these to the first by identifier;
    one with none (its response isn't in the archives) has no row.
    """
    main = records.where("record_type IN ('response', 'revisit')")
    forward = records.where("record_type IN ('request', 'metadata')").select("record_id", F.explode("concurrent_to").alias("other"))
    known = main.select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id"))
    direct = forward.join(known, "other").select("record_id", "capture_id").union(main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")))
    through = forward.join(direct.select(F.col("record_id").alias("other"), "capture_id"), "other")
    both = direct.withColumn("steps", F.lit(1)).union(through.select("record_id", "capture_id", F.lit(2)))
    return both.groupBy("record_id").agg(F.min(F.struct("steps", "capture_id")).alias("nearest")).select("record_id", "nearest.capture_id")


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: capture_id, response, request, metadata, n_requests, n_metadata.

    The structs have the records' columns that mean something for their kind.  Of several requests (or metadata
    records) of a capture the first by identifier is shown; without any, the struct is null.  Give it
    stored records: they are read several times.
    """
    links = transaction_links(records)
    parts = records.where("record_type IN ('request', 'metadata')").join(links, "record_id")
    of = lambda kind, *names: F.min_by(F.struct("record_id", *names), F.when(F.col("record_type") == kind, F.col("record_id")))
    n = lambda kind: F.count_if(F.col("record_type") == kind)
    parts = parts.groupBy("capture_id").agg(of("request", "http", "date").alias("request"), of("metadata", "fields", "date").alias("metadata"), n("request").alias("n_requests"), n("metadata").alias("n_metadata"))
    shown = [c for c in records.columns if c not in ("record_id", "concurrent_to", "fields")]
    main = records.where("record_type IN ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.struct(*shown).alias("response"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return main.join(parts, "capture_id", "left").select("capture_id", "response", "request", "metadata", count("n_requests"), count("n_metadata"))


def page_captures(assembled: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, intact) of captures that ``write_archives`` wrote; a revisit's own payload is empty."""
    note = lambda n: F.try_element_at("metadata.fields", F.lit(n))
    r = F.col("response")
    return assembled.select(
        note("page-id").try_cast("long").alias("page_id"), F.from_json(note("page-url"), "array<string>")[0].alias("url"), r["record_type"].alias("record_type"),
        r["payload_bytes"].alias("payload_bytes"), F.coalesce(r["payload_digest"], r["stated_digest"]).alias("payload_digest"), r["intact"].alias("intact"),
    )


def resolved(found: DataFrame) -> DataFrame:
    """``page_captures`` with ``refers_to``: a revisit gets the response's page_id and payload size through the digest."""
    first = found.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= LEAST_REVISIT)).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("payload_bytes").alias("first_bytes"))
    again = F.col("record_type") == "revisit"
    return found.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(again, F.col("first_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type",
        F.when(again, F.col("first_id")).alias("refers_to"), "intact",
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives of all pages, reads them back and assembles their captures: one row for each page.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.  A null html is
    empty; of rows with the same payload and the same smallest page_id, all are responses.  An empty
    table gives no rows; columns besides page_id, url and html are not read.
    """
    scratch = Scratch()
    path = f"{shared_dir(spark)}/eventide/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    records = scratch.written(read_records(spark, path), "warc-records")
    found = Scratch().written(page_captures(captures(records)), "captures")
    removed(spark, path)
    scratch.drop()
    return resolved(found)


ORACLE = """
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, CASE WHEN first_id IS NULL OR page_id = first_id THEN true END AS intact FROM f
"""
