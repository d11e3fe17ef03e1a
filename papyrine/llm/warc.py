"""WARC archives: monolithic writing, normalising to a gzip member a record, and reading by offsets.

`write_archives` writes each task's records as one gzip stream a file. `normalise` inflates each such
stream once, cuts it into records by their Content-Length, rewrites each as its own member and gives a
sidecar index (file, offset, length) that Spark's committer writes beside the archives. `read_archives`
fetches members by the index. Files are reached by pyarrow's file systems, so the folder may be any that
all executors share. Each attempt writes files of its own name; only those named by rows of the attempt
that Spark commits are read later, so lost executors leave nothing wrong behind.

Of equal payloads of at least 1000 bytes, the largest page_id is the response and the others revisit it.
Nulls: a null html is an empty payload; a null page_id is below all others, and a payload whose ids are
all null has only responses. Repeated rows with the largest page_id are all responses. A null url is
empty; control characters in it are percent-coded. An empty table writes nothing and gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BYTES, FILE_BYTES, CHUNK, MOST_CHUNK, MOST_TASKS = 1000, 64 << 20, 1 << 18, 4 << 20, 10_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages: page_id, url, html. Adds digest (hex SHA-1) and refers_to."""
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    small = pages.select("page_id", "digest", F.octet_length("html").alias("n"))
    groups = small.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("times"))
    groups = groups.where("times > 1 AND first IS NOT NULL").select("digest", "first")
    revisit = small.select("page_id", "digest").distinct().join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisit = revisit.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    match = pages.page_id.eqNullSafe(revisit.r_id) & (pages.digest == revisit.r_digest)
    return pages.join(revisit, match, "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("long").alias("n"), "digest", F.col("first").alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, html: str | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write_archives(records: DataFrame, to: str) -> DataFrame:
    """Writes monolithic archives and gives their names (a few a task), which Spark's committer writes to to/names."""

    def run(batches):
        system, folder = fs.FileSystem.from_uri(to)
        system.create_dir(folder, recursive=True)
        out, name, size, squeeze = None, "", 0, None
        for batch in batches:
            for cells in zip(*(batch.column(c) for c in ("page_id", "url", "html", "n", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, squeeze = system.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(*(c.as_py() for c in cells))
                out.write(squeeze.compress(raw))
                size += len(raw)
                if size >= FILE_BYTES:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"name": [name]})
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    records.mapInArrow(run, "name string").write.parquet(f"{to}/names")
    return records.sparkSession.read.schema("name string").parquet(f"{to}/names")


def _inflated(stream) -> Iterator[bytes]:
    """Chunks of a gzip stream, of one member or many; however well it is packed, none is over MOST_CHUNK."""
    inflate = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield inflate.decompress(chunk, MOST_CHUNK)
            chunk = inflate.unconsumed_tail or inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, by their headers' Content-Length."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: *(\d+)", held[:end], re.I)
                if not length:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("an archive ends within a record")


def normalise(names: DataFrame, source: str, to: str) -> DataFrame:
    """Rewrites monolithic archives, named by rows; the sidecar index is written beside them, as to/index."""

    def run(frames):
        (system, folder), (target, out_folder) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(to)
        target.create_dir(out_folder, recursive=True)
        for batch in frames:
            for name in batch.column("name").to_pylist():
                file, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream, target.open_output_stream(f"{out_folder}/{file}", compression=None) as out:
                    for raw in split_records(_inflated(stream)):
                        squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        rows.append((offset, len(member)))
                        offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["file", "offset", "length"])

    dealt = names.repartition(max(1, min(names.count(), MOST_TASKS)))  # an archive a task, as long as there are so many tasks
    dealt.mapInArrow(run, "file string, offset long, length long").write.parquet(f"{to}/index")
    return names.sparkSession.read.schema("file string, offset long, length long").parquet(f"{to}/index")


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes and digest, type and refers_to of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = rest.partition(b"\r\n\r\n")
    number = lambda urn: None if urn == "<urn:page:none>" else int(urn.rsplit(":", 1)[1][:-1])
    if fields["WARC-Type"] == "revisit":
        digest = binascii.hexlify(base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))).decode()
        return number(fields["WARC-Record-ID"]), int(re.search(rb"Content-Length: (\d+)", http)[1]), digest, "revisit", number(fields["WARC-Refers-To"])
    body = body[:-4]
    return number(fields["WARC-Record-ID"]), len(body), hashlib.sha1(body).hexdigest(), "response", None


def read_archives(index: DataFrame, at: str) -> DataFrame:
    """The records' digest rows, fetched member by member."""

    def run(batches):
        system, folder = fs.FileSystem.from_uri(at)
        held, stream = "", None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != held:
                    held, stream = file, system.open_input_file(f"{folder}/{file}")
                found.append(parse(zlib.decompress(stream.read_at(length, offset), 31)))
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.select("file", "offset", "length").mapInArrow(run, schema)


def archive(pages: DataFrame, to: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes pages as normalised archives under `to` and gives their index."""
    names = write_archives(plan_records(pages, least), f"{to}/whole")
    index = normalise(names, f"{to}/whole", f"{to}/records")
    system, folder = fs.FileSystem.from_uri(f"{to}/whole")
    system.delete_dir(folder)
    return index
