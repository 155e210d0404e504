"""Operator 8: WARC archives, written, normalised to one gzip member per record, indexed and read back.

Writing: each task streams its pages into monolithic gzip files (one stream for
the whole file) in the shared folder. Of pages with equal payloads of at least
`min_bytes` bytes the smallest page_id is a response record, the others are
revisit records that refer to it and hold no payload.

Normaliser: inflates a whole-file stream once, rewrites every record as a gzip
member of its own and writes a sidecar index (offset, length, type, id), so
that a record can be read with one seek.

Reading: opens the archives by the index and inflates single members.

Scale. Payloads are compared by SHA-256; each group is a pre-aggregated minimum
joined back, and only groups of two or more are in the join. A file is rolled
at FILE_BYTES, so files can be normalised and read in parallel; a task holds
one record. File names are unique for each task attempt and only names in the
written manifest are read: a retried or lost task leaves an unread file.

Defined cases: a null html is an empty payload; null urls have an empty target;
control characters in a url are percent-encoded in the header; pages with a
null page_id are responses and are referred to by none; repeated rows of the
smallest page_id are all responses; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns write equal records

ENTRY = "file string, offset long, length long, record_type string, record_id string"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP header and digest, not its payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(stream) -> tuple[dict[str, str], bytes, bytes] | None:
    """(header fields in lower case, block, raw record) of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = stream.read(size)
    if len(block) != size:
        raise ValueError("truncated WARC record")
    return fields, block, b"".join(raw) + b"\r\n" + block + b"\r\n\r\n"


def normalise(source, target, index) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite a WARC gzip stream record by record; yields and indexes (offset, length, type, id)."""
    at = 0
    with gzip.GzipFile(fileobj=source) as whole:
        stream = io.BufferedReader(whole, 1 << 20)
        while (r := read_record(stream)) is not None:
            member = gzip.compress(r[2], mtime=0)
            target.write(member)
            kind, ident = r[0].get("warc-type", ""), r[0].get("warc-record-id", "")
            index.write(f"{at}\t{len(member)}\t{kind}\t{ident}\n".encode())
            yield at, len(member), kind, ident
            at += len(member)


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with `_first`: the response's page_id for a revisit, else null."""
    p = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("_sha"))
    groups = (p.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes).groupBy("_sha")
              .agg(F.min("page_id").alias("_min"), F.max("page_id").alias("_max")).where("_min <> _max").select("_sha", "_min"))
    return p.join(groups, "_sha", "left").withColumn(
        "_first", F.when(F.col("page_id") > F.col("_min"), F.col("_min"))).drop("_min", "_sha")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Monolithic archives of all pages in ``folder``; the manifest (file, records)."""
    def run(batches):
        fs, root = open_folder(folder)
        out = raw = name = None
        size = count = 0

        def close():
            out.close()
            raw.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

        for b in batches:
            for page_id, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "_first"))):
                if out is None:
                    name, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    raw = fs.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
                r = record("response" if first is None else "revisit", page_id, url, (html or "").encode(), first)
                out.write(r)
                size, count = size + len(r), count + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    fs, root = open_folder(folder)
    fs.create_dir(root)
    return C.pin(plan(pages, min_bytes).mapInArrow(run, "file string, records long"))


def normalise_all(manifest: DataFrame, folder: str) -> DataFrame:
    """One member per record and a sidecar index for every archive of the manifest; all index entries."""
    def run(batches):
        fs, root = open_folder(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                new = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(name, compression=None) as source, fs.open_output_stream(new, compression=None) as target, \
                        fs.open_output_stream(f"{new}.idx") as index:
                    rows = []
                    for row in normalise(source, target, index):
                        rows.append((new, *row))
                        if len(rows) >= 10_000:
                            yield _entries(rows)
                            rows = []
                    if rows:
                        yield _entries(rows)

    n = max(1, manifest.count())
    return C.pin(manifest.select("file").repartition(n, "file").mapInArrow(run, ENTRY))


def _entries(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3]), pa.array(cols[4])],
                                      names=["file", "offset", "length", "record_type", "record_id"])


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None):
    m = re.search(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read(entries: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, inflated alone: page_id, payload size and digest, type, refers_to.

    A response's size and digest are those of the payload that was read, and
    must be the ones its header states; a revisit has its response's.
    """
    def run(batches):
        fs, _ = open_folder(folder)
        name = source = None
        for b in batches:
            out = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(file)
                source.seek(offset)
                fields, block, _ = read_record(io.BytesIO(gzip.decompress(source.read(length))))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (size, digest) != (len(payload), base32_sha1(payload)):
                    raise ValueError(f"record {fields['warc-record-id']} of {file} is damaged")
                out.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to"))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    # a slice of a file's records is one unit of work, read in order of place
    part = F.floor(F.col("offset") / F.lit(8 << 20))
    return entries.repartition("file", part).sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all pages; one row per record read."""
    folder = folder or C.scratch_path(pages.sparkSession, "warc")
    return read(normalise_all(write(pages, folder, min_bytes), folder), folder)


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b),
d AS (SELECT DISTINCT h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), 'string_agg', '') AS digest FROM p)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f ON p.b = f.b JOIN d USING (h)
"""


@C.query("op8_warc", SQL)
def op8(spark, sf_dir):
    """Every page through WARC archives and back."""
    return archive(C.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"))
