"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. Reading tasks take byte ranges of
the archives: a task looks for the gzip magic number from the start of its
range, accepts a place if the member there decodes to a WARC header and is
followed by another member or the end of the file, and owns the records that
start inside its range. From the first one on it goes from member to member,
reading past the end of the range where the last record does. A record's
payload is the only thing held whole.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest id is written as response, the others as revisits of it, which
hold the payload's length and digest but no payload. Archive names are
unique to a task attempt, and the manifest, a table that Spark commits, names
those of the attempts that succeeded; so a lost executor leaves at most a
file that nothing reads.

Defined results: a null html is an empty payload; a null url has no target
header and reads back as null; rows with a null id are responses and read
back with a null id; rows repeated with the smallest id are each a response;
other columns are not written; an empty table makes an archive folder
without records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import new_folder, written

MIN_REVISIT = 100
SPLIT_BYTES = 1 << 23
STEP_BYTES = 1 << 20
#: First rows of duplicate groups (about 100 bytes each) sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = ("page_id long, url string, record_type string, refers_to long, payload binary, "
          "payload_bytes long, payload_digest string")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record as a gzip member; ``first``: the response that it revisits."""
    head = [("WARC-Type", "response" if first is None else "revisit"),
            ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if first is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first, digest)),
                 ("X-Refers-To-Page-Id", str(first))]
    block = HTTP % len(payload) + (payload if first is None else b"")
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(wbits=31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the response a revisit refers to)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    groups, _ = written(rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
        "payload-groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes the archives; returns their manifest: path, length, records."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _at(folder)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        length = records = 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(c for c in batch.columns)):
                    data = member(*(v.as_py() for v in row))
                    out.write(data)
                    length += len(data)
                    records += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [length], "records": [records]})

    manifest, _ = written(typed(pages).mapInArrow(run, "path string, length long, records long"), "warc-manifest")
    return manifest


class _Range:
    """Bytes of a file from ``start`` on, read as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.start, self.size = file, start, size
        file.seek(start)
        self.data = b""

    def upto(self, end: int) -> bool:
        """Whether the file has bytes at ``end - 1``, which are then in ``data``."""
        missing = min(end, self.size) - self.start - len(self.data)
        if missing > 0:
            self.data += self.file.read(missing)
        return end <= self.size

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content and end of the gzip member at ``at``, if it is a WARC record's."""
        unpack, out, pos = zlib.decompressobj(wbits=31), [], at
        try:
            while not unpack.eof:
                if pos >= self.size:
                    return None
                self.upto(pos + STEP_BYTES)
                chunk = self.data[pos - self.start:pos - self.start + STEP_BYTES]
                out.append(unpack.decompress(chunk))
                pos += len(chunk) - len(unpack.unused_data)
                if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        self.upto(pos + len(MAGIC))
        after = self.data[pos - self.start:pos - self.start + len(MAGIC)]
        return (b"".join(out), pos) if pos == self.size or after == MAGIC else None


def scan(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """Records that start in [start, end) of an archive."""
    part = _Range(file, start, size)
    part.upto(end + len(MAGIC) - 1)
    at = start
    while at < end:
        at = part.data.find(MAGIC, at - start) + start
        if at < start or at >= end:
            return
        found = part.member(at)
        if found is None:
            at += 1
        else:
            yield found[0]
            at = found[1]


def parse(record: bytes) -> dict:
    """Fields of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b": ", 1)[1])
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-Id"),
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
            "payload": payload if fields["WARC-Type"] == "response" else None,
            "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2]}


def read_archives(manifest: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives named by ``path`` and ``length``, in byte ranges."""
    ranges = manifest.where("length > 0").select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _at(row["path"])
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for record in scan(file, row["start"], min(row["start"] + split, row["length"]), row["length"]):
                        held.append(parse(record))
                        size += len(record)
                        if size > STEP_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    slots = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(4 * slots, int(ranges.sparkSession.conf.get(
        "spark.sql.shuffle.partitions")))).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back; a response's digest is that of
    the payload read, which must be the one that its header states."""
    rows = read_archives(write_archives(pages))
    digest = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha2("payload", 256))
    return rows.select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(
            F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("payload_digest") == digest, digest).otherwise(
            F.raise_error(F.lit("payload differs from its header's digest"))).alias("payload_digest"),
        "record_type", "refers_to")


ORACLE = f"""
with r as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select payload_digest, min(page_id) as first_id from r where payload_bytes >= {MIN_REVISIT} group by 1)
select r.page_id, r.payload_bytes, r.payload_digest,
       case when r.page_id > f.first_id then 'revisit' else 'response' end as record_type,
       case when r.page_id > f.first_id then f.first_id end as refers_to
from r left join f using (payload_digest)
"""
