"""WARC archives: writing, reading, and reassembly of segmented records.

Writing gives one record a row; a revisit names the record that it refers to, unless
that row is there more than once, when it names page and digest. A payload is the body of an HTTP response in
chunked framing; a block longer than a segment is cut into a first record and
``continuation`` records. Of rows with equal payloads, the one with the largest id
is the ``response`` and the others are ``revisit`` records without a body.

Archives are written by Spark's text writer: a record's bytes but the last line
feed are the line, the line feed is the separator. So they go to any file system
that Spark writes to, a task's file appears only when the task commits, and each
file is a valid gzipped WARC file.

A task packs pages into files by their running bytes, whatever the sizes of others:
a file holds up to ``FILE_BYTES`` of records, or one larger page.

Reading parses whole files by content length, those of other writers too: records
of other kinds than responses, revisits and resources are left out, and pages are
known by their identifiers only in archives written here. Whole records are decoded where
they are read. Segments are grouped by the identifier of their origin, ordered by
number, checked against the total length, and only then is the chunked framing
decoded; nothing else is shuffled. A group is one record, so it is as large as one
payload. Revisits get their size from the record they name.

The digests that repeat are broadcast only up to ``broadcast_keys``, else joined by
shuffle (where adaptive execution splits a digest that a third of rows share).

Defined results: a null html is an empty payload; equal empty payloads are revisits
as others; a null url leaves the target out, line breaks in it are escaped; a null
page id never is the response of other ids and is read back as null; rows with
the response's id and payload are responses each; an empty table gives no
records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.llm._shared import discard, in_batches, materialize, shared_path, sized

#: Bytes of a record's block from which it is segmented, and of a chunk of its body.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
#: Bytes of records in an archive file (or one page), about.
FILE_BYTES = 16 << 20
# Names of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class WarcError(ValueError):
    """An archive that doesn't hold what it says."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing, trailers left out."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise WarcError("a chunk has no size")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, end, body = block.partition(b"\r\n\r\n")
    if not end:
        raise WarcError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str, segment_bytes: int, chunk_bytes: int) -> bytes:
    """The records of one page, one after another; without a serial it is the page's only record of that payload."""
    digest = base32_sha1(payload)
    name = f"urn:page:{'' if page_id is None else page_id}:{digest}" + (f"#{serial}" if serial else "")
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " else c for c in url)))
    if refers_to is not None:
        fields += [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        return record(fields, _HTTP + b"\r\n")
    fields.append(("WARC-Type", "response"))
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return record(fields, block)
    pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        own = [("WARC-Record-ID", f"<{name}-{k}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if k == len(pieces):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(own, piece))
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise WarcError(f"no record begins at byte {at}")
        fields = {k.decode().strip().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        if "content-length" not in fields:
            raise WarcError(f"the record at byte {at} has no length")
        start = end + 4
        at = start + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise WarcError(f"the record at byte {start} doesn't end where its length says")
        yield fields, data[start:at]
        at += 4


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, broadcast_keys: int = 1_000_000) -> str:
    """Write all pages to gzipped archive files under ``path``; payloads from ``min_bytes`` on are written once."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"), F.sha1(payload).alias("_sha"))
    rows = rows.withColumn("_size", F.octet_length("_payload"))
    keys = materialize(rows.select("_sha", "_id", "_size"), "keys")
    equal = keys.where(F.col("_size") >= min_bytes).groupBy("_sha").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    equal = materialize(equal.where("_n > 1 and _top is not null").drop("_n"), "equal_payloads")
    tops = keys.join(sized(equal, broadcast_keys), "_sha").where("_id = _top").groupBy("_sha").agg((F.count(F.lit(1)) == 1).alias("_only"))
    equal = materialize(equal.join(tops, "_sha"), "equal_payloads")
    refers = F.when(F.col("_id").isNull() | (F.col("_id") != F.col("_top")), F.col("_top"))
    named = F.coalesce((F.col("_id") == F.col("_top")) & F.col("_only"), F.lit(False))
    rows = rows.join(sized(equal, broadcast_keys), "_sha", "left").select("_id", "_url", "_payload", refers.alias("_refers"), named.alias("_named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, pack, held = TaskContext.get().partitionId(), 0, [], 0

        def sent() -> pa.RecordBatch:
            whole = b"".join(pack)
            pack.clear()
            return pa.RecordBatch.from_arrays([pa.array([memoryview(whole)[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for page_id, url, data, refers_to, is_named in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    serial += 1
                    records = page_records(page_id, url, data, refers_to, "" if is_named else f"{task}.{serial}", segment_bytes, chunk_bytes)
                    if pack and held + len(records) > FILE_BYTES:
                        yield sent()
                        held = 0
                    pack.append(records)
                    held += len(records)
        if pack:
            yield sent()

    lines = rows.transform(in_batches, run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("append").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    discard(keys)
    return path


_PAGE = re.compile(r"<urn:page:(-?\d*):")
_READ = "origin string, page_id long, url string, kind string, refers_to string, payload binary, bytes long, digest string, segment int, total long, block binary"
_ARROW_READ = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _READ.split(", ")])
_KINDS = ("response", "revisit", "resource")


def decoded(kind: str, digest: str | None, block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of a whole record (none for revisits) and its digest, which is checked against the record's."""
    payload = None if kind == "revisit" else block if kind == "resource" else payload_of(block)
    said = digest.removeprefix("sha1:").upper() if digest and digest.startswith("sha1:") else None
    if payload is None:
        return None, said
    own = base32_sha1(payload)
    if said and len(said) == 32 and said != own:
        raise WarcError("a payload doesn't have its digest")
    return payload, own


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The payloads of all responses, revisits and resources under ``path``, segments reassembled.

    Returns record_id, page_id (null in archives of other writers), url, payload
    (null for revisits), payload_digest, record_type, the record that a revisit
    names, and n_segments. What doesn't fit its own lengths or SHA-1 raises an error.
    Without ``payloads`` they are checked and measured, and not returned.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW_READ
        for batch in batches:
            for content in batch.column(0):
                raw, rows, held = content.as_buffer(), [], 0
                data = gzip.decompress(raw) if memoryview(raw)[:2].tobytes() == b"\x1f\x8b" else raw.to_pybytes()
                for f, block in parse_records(data):
                    kind, digest = f["warc-type"], f.get("warc-payload-digest")
                    whole = kind != "continuation" and "warc-segment-number" not in f
                    if whole and kind not in _KINDS:
                        continue
                    origin = f["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"]
                    page, total = _PAGE.match(origin), f.get("warc-segment-total-length")
                    known = (origin, int(page[1]) if page and page[1] else None, f.get("warc-target-uri"), kind, f.get("warc-refers-to"))
                    if whole:
                        payload, own = decoded(kind, digest, block)
                        rows.append((*known, payload if payloads else None, None if payload is None else len(payload), own, None, None, None))
                    else:
                        rows.append((*known, None, None, digest, int(f.get("warc-segment-number", 1)), total and int(total), block))
                    held += len(block)
                    if len(rows) == 256 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    # written, so that archives are read once for the whole records and for the segments
    parsed = materialize(files.transform(in_batches, parse, _READ), "records")
    whole = parsed.where("segment is null").select(F.col("origin").alias("record_id"), "page_id", "url", F.col("kind").alias("record_type"), F.col("refers_to").alias("_refers"), "payload", F.col("bytes").alias("_bytes"), F.col("digest").alias("payload_digest"), F.lit(1).alias("n_segments"))
    grouped = parsed.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("segments"),
        *[F.first(F.when(F.col("segment") == 1, F.col(c)), ignorenulls=True).alias(c) for c in ("kind", "page_id", "url", "refers_to", "digest")],
    )
    grouped = grouped.where(F.col("kind").isNull() | F.col("kind").isin(*_KINDS))
    assembled = grouped.select(F.col("origin").alias("record_id"), "page_id", "url", "kind", "refers_to", "digest", F.col("segments.segment").alias("numbers"), F.col("segments.total").alias("totals"), F.col("segments.block").alias("blocks"))
    schema = T.StructType([*[T.StructField(n, t) for n, t in (("record_id", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("_refers", T.StringType()), ("payload", T.BinaryType()), ("_bytes", T.LongType()), ("payload_digest", T.StringType()), ("n_segments", T.IntegerType()))]])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                kinds, digests, numbers, totals, blocks = (part.column(j).to_pylist() for j in (3, 5, 6, 7, 8))
                payloads_here, found = [], []
                for kind, digest, number, total, pieces in zip(kinds, digests, numbers, totals, blocks, strict=True):
                    if number != list(range(1, len(number) + 1)) or total[-1] is None or sum(map(len, pieces)) != total[-1]:
                        raise WarcError("segments are missing, repeated, or not of their total length")
                    payload, own = decoded(kind, digest, b"".join(pieces))
                    payloads_here.append(payload)
                    found.append(own)
                sizes = [None if p is None else len(p) for p in payloads_here]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(5)), pa.array(payloads_here if payloads else [None] * part.num_rows, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.string()), pa.array([len(n) for n in numbers], pa.int32())], names=schema.names)

    return whole.unionByName(assembled.transform(in_batches, assemble, schema))


def resolve_revisits(records: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Give revisits the size of the payload that they refer to; the payloads themselves are left out."""
    rows = records.drop("payload")
    own = r"^<urn:page:(-?\d+):([A-Z2-7]+)"

    def name(record: str) -> F.Column:
        """Page and digest of an identifier written here, whatever its serial; others as they are."""
        return F.when(F.regexp_like(record, F.lit(own)), F.concat_ws(":", F.regexp_extract(record, own, 1), F.regexp_extract(record, own, 2))).otherwise(F.col(record))

    revisits = rows.where("record_type = 'revisit'").withColumn("_key", name("_refers")).drop("_bytes")
    others = rows.where("record_type != 'revisit'")
    sizes = others.groupBy(name("record_id").alias("_key")).agg(F.first("_bytes").alias("payload_bytes"), F.first("page_id").alias("refers_to"))
    sizes = sizes.join(sized(materialize(revisits.select("_key").distinct(), "named"), broadcast_keys), "_key", "left_semi")
    # both sides are written, so a record that a third of all pages revisit is a skewed join that can be split
    revisits = revisits.join(sized(materialize(sizes, "sizes"), broadcast_keys), "_key", "left")
    others = others.withColumn("refers_to", F.lit(None).cast("long")).withColumnRenamed("_bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments"]
    return others.select(*columns).unionByName(revisits.select(*columns))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = write_archives(pages, shared_path(spark, "archives"), **options)
    return resolve_revisits(materialize(read_archives(spark, path, payloads=False).drop("payload"), "read_back"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages
), top AS (SELECT h, max(page_id) AS top FROM p GROUP BY h
), d AS (
  SELECT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1) for i in range(32)], '') AS digest FROM top
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN top USING (h) JOIN d USING (h)
"""
