"""WARC archives with an index that is written first and read before any byte.

Writing: each task appends gzip members to archive files of its own in a shared
folder and returns, per record, its file, offset, length, URL and payload
digest. Those rows are the index, a Parquet table. Of equal payloads one is
written as a response; the others are revisit records without a payload.

Reading: the index rows of the wanted records are sorted by file and offset and
coalesced into byte ranges. A task reads a range at once and cuts it up.

A file is named after its task attempt and counts only if the attempt's index
rows were committed, so the archives survive lost and repeated tasks.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored, work_dir

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = (
    "page_id {id}, url string, file string, offset long, length long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to {id}"
)
READ_SCHEMA = (
    "page_id {id}, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to {id}"
)


@dataclass(frozen=True)
class WarcSettings:
    min_revisit_bytes: int = 100  # smaller payloads are always written
    file_bytes: int = 256 << 20  # an archive file is closed beyond this
    gap_bytes: int = 64 << 10  # unwanted bytes that a range may include
    range_bytes: int = 8 << 20  # a range is closed beyond this
    task_bytes: int = 4 << 20  # of archives, compressed, that a reading task gets, about
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _header_value(value: object) -> bytes:
    """A header value on one line; control characters and % are percent-encoded."""
    raw = str(value).encode()
    return b"".join(b"%%%02X" % c if c < 32 or c in (37, 127) else bytes([c]) for c in raw)


def _plain(value: bytes) -> str:
    out, at = bytearray(), 0
    while at < len(value):
        if value[at] == 37:
            out.append(int(value[at + 1 : at + 3], 16))
            at += 3
        else:
            out.append(value[at])
            at += 1
    return out.decode()


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    name = lambda x: f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {x}'.encode()).digest())}>"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    size = len(payload)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(f"{page_id} {digest}" if kind == "revisit" else page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Payload-Length", size),
    ]
    if page_id is not None:
        head.append(("Page-ID", page_id))
    if url is not None:
        head.append(("WARC-Target-URI", url))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("Refers-To-Page-ID", refers_to)]
    else:
        body += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    lines = [b"WARC/1.1"] + [k.encode() + b": " + _header_value(v) for k, v in head]
    return CRLF.join(lines) + CRLF + CRLF + body + CRLF + CRLF


def _parse(record: bytes) -> tuple[dict[str, bytes], bytes]:
    """Header fields of a record and its HTTP payload."""
    head, _, rest = record.partition(CRLF + CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
    fields = {k.decode(): v for k, v in fields.items()}
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(CRLF + CRLF)[2]


def typed(pages: DataFrame, settings: WarcSettings) -> DataFrame:
    """Add payload, digest, record type and, for revisits, the page referred to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    large = F.col("payload_bytes") >= settings.min_revisit_bytes
    firsts = (
        keyed.where(large)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and first_id is not null")
    )
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    # payloads move only if there are more repeated ones than can be broadcast
    return (
        attach(keyed, firsts, ["payload_digest"], "left", weight="_n")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first_id")))
        .select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    )


def write_warc(pages: DataFrame, path: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path`` and return the stored index.

    A null html is an empty payload; a null URL is left out of the record; a
    null page_id is kept null. Rows that tie for the smallest page_id of a
    payload are all responses, and so are the rows of a payload that has no
    page_id. An empty table writes no file and an empty index.
    """
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(path)
        system.create_dir(root, recursive=True)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        stream, n, at, name = None, 0, 0, ""
        try:
            for batch in batches:
                rows, files = batch.to_pydict(), ([], [], [], [])
                for page_id, url, payload, digest, record_type, refers_to in zip(*rows.values()):
                    if stream is None or at >= settings.file_bytes:
                        if stream is not None:
                            stream.close()
                        name, n, at = f"{part}-{n:04d}.warc.gz", n + 1, 0
                        stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    raw = _record(page_id, url, payload, digest, record_type, refers_to, settings.date)
                    member = zlib.compressobj(settings.level, zlib.DEFLATED, 31)
                    data = member.compress(raw) + member.flush()
                    stream.write(data)
                    for column, value in zip(files, (name, at, len(data), len(payload))):
                        column.append(value)
                    at += len(data)
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(files[0], pa.string())]
                    + [pa.array(x, pa.int64()) for x in files[1:]]
                    + [batch.column(3), batch.column(4), batch.column(5)],
                    names=["page_id", "url", "file", "offset", "length", "payload_bytes", "payload_digest",
                           "record_type", "refers_to"],
                )
        finally:
            if stream is not None:
                stream.close()

    return stored(typed(pages, settings).mapInArrow(run, INDEX_SCHEMA.format(id=kind)), "warc_index")


def byte_ranges(selected: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """(file, start, stop, parts): ranges that cover the selected index rows.

    The window runs over the records of one archive file, whose size is bounded.
    """
    in_file = Window.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    gap = F.col("offset") - F.lag(end).over(in_file)
    starts = F.when(gap.isNull() | (gap > settings.gap_bytes), F.col("offset"))
    return (
        selected.select("file", "offset", "length", starts.alias("_new"))
        .distinct()
        .withColumn("_start", F.last("_new", ignorenulls=True).over(in_file))
        .withColumn("_piece", F.floor((F.col("offset") - F.col("_start")) / settings.range_bytes))
        .groupBy("file", "_start", "_piece")
        .agg(
            F.min("offset").alias("start"),
            F.max(end).alias("stop"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"),
        )
        .select("file", "start", "stop", "parts")
    )


def read_warc(selected: DataFrame, path: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Read the records of the index rows ``selected`` back from the archives below ``path``.

    The digest and size of a response are taken from the bytes read; those of a
    revisit, which has no payload, from its header.
    """
    kind = dict(selected.dtypes)["page_id"]
    schema = READ_SCHEMA.format(id=kind)
    number = kind not in ("string",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(path)
        key = lambda v: None if v is None else (int(v) if number else _plain(v))
        for batch in batches:
            for file, start, stop, parts in zip(*batch.to_pydict().values()):
                with system.open_input_file(f"{root}/{file}") as f:
                    data = f.read_at(stop - start, start)
                rows = []
                for part in parts:
                    at = part["offset"] - start
                    fields, payload = _parse(zlib.decompress(data[at : at + part["length"]], 31))
                    record_type = fields["WARC-Type"].decode()
                    if record_type == "response":
                        found = (payload, len(payload), hashlib.sha256(payload).hexdigest())
                    else:
                        digest = fields["WARC-Payload-Digest"].decode().removeprefix("sha256:")
                        found = (None, int(fields["Payload-Length"]), digest)
                    url = fields.get("WARC-Target-URI")
                    refers_to = key(fields.get("Refers-To-Page-ID"))
                    rows.append((key(fields.get("Page-ID")), None if url is None else _plain(url), *found, record_type, refers_to))
                columns = list(zip(*rows))
                ids = pa.int64() if number else pa.string()
                kinds = [ids, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), ids]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    ranges = byte_ranges(selected, settings)
    # a range is dealt by its place, so that one large file is read by many tasks; their
    # number follows the bytes to be read, as a row per range says nothing about them
    total = selected.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(1, math.ceil(total / settings.task_bytes))
    return ranges.repartition(n_tasks, "file", "start").mapInArrow(run, schema)


@query(
    "op8_warc",
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``pages`` written to archives and read back through the index."""
    path = work_dir(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
