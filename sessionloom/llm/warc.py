"""WARC archives that are read by their index.

Every record is a gzip member of its own, so that it can be read alone.

``write_archives`` turns records into WARC/1.1 files, one per task, and returns
the index: archive, offset, length, URL and digest of every record. The files
go to the shared folder under a name that no other task attempt uses, and only
attempts that succeeded are in the index, so a lost executor leaves at most an
unused file. ``read_records`` sorts the selected index rows by archive and
offset and joins ranges that lie close together into one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import bound_batches, released

#: Payloads of at least so many bytes may be revisits of an equal one.
LEAST_SHARED = 100
#: A gap of up to so many bytes between two records is read rather than skipped.
GAP_BYTES = 64 << 10
#: A coalesced read takes at most so many bytes, or one record.
READ_BYTES = 8 << 20
#: Bytes of archives that one task reads, about, and tasks at most.
TASK_BYTES, MOST_TASKS = 4 << 20, 50_000
#: Fixed, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
#: Of gzip.
LEVEL = 2

INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"


def _target(url: str | None) -> list[str]:
    """The headers of a URL; none for a null one. Line breaks would end the field, so such a URL comes encoded too."""
    if url is None:
        return []
    plain = url.replace("\r", "%0D").replace("\n", "%0A")
    return [f"WARC-Target-URI: {plain}"] + ([f"X-Target-URI-Base64: {base64.b64encode(url.encode()).decode()}"] if plain != url else [])


def _url(fields: dict[str, str]) -> str | None:
    coded = fields.get("x-target-uri-base64")
    return fields.get("warc-target-uri") if coded is None else base64.b64decode(coded).decode()


def _record_id(page_id, digest: str) -> str:
    """The same for rows of one page and payload only."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload, and names the record it refers to, whose payload is equal."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", *_target(url),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {head[:80]!r}")
    if fields["warc-type"] == "response" and hashlib.sha256(rest[:n]).hexdigest() != fields["warc-payload-digest"].removeprefix("sha256:"):
        raise ValueError(f"payload and digest differ: {head[:80]!r}")
    return fields, rest[:n]


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        out = store.open_output_stream(name, compression=None)
                    raw = gzip.compress(record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["record_type"], r["refers_to"]), LEVEL, mtime=0)
                    out.write(raw)
                    rows.append((r["page_id"], name.rsplit("/", 1)[1], at, len(raw), r["url"], r["payload_digest"], r["record_type"], r["refers_to"]))
                    at += len(raw)
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        held: tuple = (None, None)
        for batch in batches:
            rows, i = batch.to_pylist(), 0
            while i < len(rows):
                # A run of near records of one archive is one read.
                j, start = i + 1, rows[i]["offset"]
                end = start + rows[i]["length"]
                while j < len(rows) and rows[j]["archive"] == rows[i]["archive"] and 0 <= rows[j]["offset"] - end <= GAP_BYTES and rows[j]["offset"] + rows[j]["length"] - start <= READ_BYTES:
                    end = rows[j]["offset"] + rows[j]["length"]
                    j += 1
                if held[0] != rows[i]["archive"]:
                    if held[1] is not None:
                        held[1].close()
                    held = (rows[i]["archive"], store.open_input_file(f"{base}/{rows[i]['archive']}"))
                block = held[1].read_at(end - start, start)
                out = []
                for r in rows[i:j]:
                    fields, payload = parse_record(gzip.decompress(block[r["offset"] - start : r["offset"] - start + r["length"]]))
                    own, refers = (fields.get(k, "<urn:page::>").split(":")[2] for k in ("warc-record-id", "warc-refers-to"))
                    out.append((
                        int(own) if own else None, _url(fields), int(fields["x-payload-length"]),
                        fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], int(refers) if refers else None, payload,
                    ))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)], names=[x.split()[0] for x in READ.split(", ")])
                i = j
        if held[1] is not None:
            held[1].close()

    return read


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def write_archives(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """Archives of every row of ``pages`` (page_id, url, html), and their index, as a table.

    A null html is an empty payload, a null url no target. Of records
    with equal payloads of LEAST_SHARED bytes or more the one with the least
    page_id is the response and the others revisit it. Rows with a null page_id
    are always responses; of rows that share both payload and least page_id all
    are responses. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = scratch.path("archives")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"), (F.octet_length(html) >= LEAST_SHARED).alias("large"),
    )
    # Only ids and digests are grouped, with map-side minima; the few groups of
    # more than one page are a table, so that Spark may split a very large one.
    groups = scratch.save(
        rows.where("large and page_id is not null").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first <> last").drop("last"), "groups")
    revisit = F.col("large") & (F.col("page_id") > F.col("first"))
    typed = rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.when(F.coalesce(revisit, F.lit(False)), F.col("first")).alias("refers_to"),
    )
    index = scratch.save(typed.mapInArrow(released(_writer(folder)), INDEX), "index")
    return index, folder


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows name, read from the archives in coalesced ranges.

    Index rows are few bytes for many to be read, so it is the bytes that say how many tasks read.
    """
    bound_batches(index.sparkSession)
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(max(1, min(MOST_TASKS, -(-size // TASK_BYTES))))
    order = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return order.mapInArrow(released(_reader(folder)), READ)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all of ``pages`` to archives and read every record back; a row per page."""
    bound_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc")
    index, folder = write_archives(pages, scratch)
    return read_records(index, folder)
