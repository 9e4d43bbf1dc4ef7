"""WARC archives: index first, then coalesced byte-range reads.

Writing: rows are grouped by payload digest (pre-aggregated), the row with the largest id of each group becomes the
`response` record and the others `revisit` records that refer to it. Each task streams its records into files of at most
`roll` bytes in the shared folder and returns one index row a record: file, offset, length, url, digest. File names hold
the task attempt and a random part, and the index is written as a table from the attempts that succeeded, so a lost or
repeated task leaves an unused file but never a wrong index row.

Reading: the selected index rows are dealt by file, sorted by offset, and ranges with a gap of at most `gap` bytes are
read at once, up to `chunk` bytes; records are parsed from those chunks.

Defined cases: null html is an empty payload; rows with equal payload and the same largest id are all responses; a null id
sorts below any id; null or empty url: an empty target; in a target, control characters, blanks and other letters are
percent-encoded, and the url itself then goes along in a header of its own, so that it is read back as it was written;
other columns are not read, so their names can't clash; an empty table gives empty archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, frugal, materialize, prepare

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 256 << 20
GAP = 64 << 10
CHUNK = 8 << 20


def payload_digest(data: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def target(url: str | None) -> str:
    return quote(url or "", safe="".join(map(chr, range(33, 127))))


def own_url(url: str | None) -> list[str]:
    """A header with the url in base64 (null: -) where the target does not tell it."""
    if url is None:
        return ["X-Page-URL: -"]
    return [] if target(url) == url else [f"X-Page-URL: {base64.b64encode(url.encode()).decode()}"]


def url_of(fields: dict[str, str]) -> str | None:
    own = fields.get("x-page-url")
    return fields["warc-target-uri"] if own is None else None if own == "-" else base64.b64decode(own).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record with its closing blank lines; a revisit has no block but names the payload's digest and length."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *own_url(url),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; checks its frame."""
    head, mark, rest = bytes(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("bad record length")
    return fields, rest[:size]


def assign_types(pages: DataFrame, id_col: str, url: str, html: str, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Payloads under `least` bytes are all responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("mark"))
    groups = rows.where(F.length("payload") >= least).groupBy("mark").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    shared = materialize(groups.where("n > 1").select("mark", "top"), "warc-groups")
    a, b = rows.alias("a"), shared.alias("b")
    joined = a.join(b, (F.col("a.mark") == F.col("b.mark")) & ~F.col("a.page_id").eqNullSafe(F.col("b.top")), "left")
    return joined.select("a.page_id", "a.url", "a.payload", F.col("b.top").alias("refers_to"), F.col("b.mark").isNotNull().alias("revisit"))


def write_archives(typed: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write the records below `folder` and return the stored index: file, offset, length, page_id, url, digest, record_type."""
    prepare(typed.sparkSession)
    kind = typed.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        base = f"{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        out, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                index: list[list] = [[] for _ in range(5)]
                for page_id, url, payload, ref, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at, number = f"{base}-{number:04d}.warc", 0, number + 1
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}")
                    digest = payload_digest(payload)
                    data = record(page_id, url, payload, digest, ref, again)
                    out.write(data)
                    for col, value in zip(index, (name, at, len(data), digest, "revisit" if again else "response")):
                        col.append(value)
                    at += len(data)
                file, offset, length, digest, types = index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), batch.column("page_id"),
                     batch.column("url"), pa.array(digest, pa.string()), pa.array(types, pa.string())],
                    ["file", "offset", "length", "page_id", "url", "digest", "record_type"],
                )
        finally:
            if out is not None:
                out.close()

    index = typed.mapInArrow(frugal(work), f"file string, offset long, length long, page_id {kind}, url string, digest string, record_type string")
    return materialize(index, "warc-index")


def read_records(selected: DataFrame, folder: str, gap: int = GAP, chunk: int = CHUNK) -> DataFrame:
    """The records of the selected index rows, read from the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for a revisit). A response's digest is computed from the bytes read."""
    spark = prepare(selected.sparkSession)
    kind = selected.schema["page_id"].dataType.simpleString()
    to_id = int if kind in ("bigint", "int", "smallint", "tinyint") else str

    def page(name: str):
        value = name[len("<urn:page:") : -1]
        return None if value == "null" else to_id(value)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        source, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            cols: list[list] = [[] for _ in range(7)]
            i = 0
            while i < len(rows):
                file, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == file and rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= chunk:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if opened != file:
                    if source is not None:
                        source.close()
                    source, opened = fs.open_input_file(f"{root}/{file}"), file
                data = memoryview(source.read_at(end - start, start))
                for _, offset, size in rows[i:j]:
                    fields, block = parse(data[offset - start : offset - start + size])
                    again = fields["warc-type"] == "revisit"
                    stored = fields["warc-payload-digest"].removeprefix("sha1:")
                    digest = stored if again else payload_digest(block)
                    if digest != stored:
                        raise ValueError(f"digest differs in {file} at {offset}")
                    row = (
                        page(fields["warc-record-id"]), url_of(fields), int(fields["warc-payload-length"]) if again else len(block),
                        digest, fields["warc-type"], page(fields["warc-refers-to"]) if again else None, None if again else block,
                    )
                    for col, value in zip(cols, row):
                        col.append(value)
                i = j
            key = batch.schema.field("page_id").type
            kinds = (key, pa.string(), pa.int64(), pa.string(), pa.string(), key, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )
        if source is not None:
            source.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file is of bounded size, so dealing by file and stretch keeps tasks even; a stretch is read in one go
    stretch = F.floor(F.col("offset") / F.lit(chunk)).alias("stretch")
    dealt = selected.select("file", "offset", "length", "page_id", stretch).repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(
        frugal(work), f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary"
    )


def archive_folder(spark) -> str:
    path = fresh_path(spark, "warc")
    return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{os.path.abspath(path)}"


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write every page, then read every record back by the index."""
    folder = folder or archive_folder(pages.sparkSession)
    index = write_archives(assign_types(pages, id_col, url, html, least), folder)
    return read_records(index, folder)
