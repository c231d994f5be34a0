"""WARC archives: a writer with revisit records and a reader that salvages what damage leaves.

Every record is a gzip member of its own, so a reader can begin again at any
member. After a failed check the reader searches for the next place where a
record can begin, recovers what follows, and reports the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import new_path, written

#: Payloads below this many bytes are always stored.
LEAST_REVISIT_BYTES = 100
#: Bytes read at once.
BLOCK = 1 << 20
#: Bytes of an archive after which its task begins another.
ARCHIVE_BYTES = 128 << 20
#: What a record may grow to: a cell of a table holds less than 2 GiB, so no record of ours is longer. Beyond, the bytes are a reported gap.
MOST_RECORD_BYTES = (1 << 31) + (1 << 20)
MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed record. A revisit keeps the HTTP headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    """Bytes [offset, end) that hold no record that passes its checks."""

    offset: int
    end: int
    reason: str


def parse(data: bytes | bytearray) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of ``data``; ValueError if a check fails."""
    if not _VERSION.match(data):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in bytes(data[:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without a colon")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = bytes(memoryview(data)[start:stop])
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise ValueError("block digest differs")
    return headers, block, stop + 4


class _Window:
    """A forward view of a file that keeps only the bytes still needed; growing and dropping cost the bytes added and dropped."""

    def __init__(self, source: BinaryIO):
        self.source, self.data, self.base, self.ended = source, bytearray(), 0, False

    def more(self) -> bool:
        if not self.ended:
            part = self.source.read(BLOCK)
            self.ended = not part
            self.data += part
        return not self.ended

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


def _inflate(view: _Window) -> tuple[bytes, int]:
    """The member at the start of the window and its compressed length."""
    coder, out, size, at = zlib.decompressobj(31), [], 0, 0
    while True:
        if at == len(view.data) and not view.more():
            raise ValueError("member is cut short")
        part = view.data[at : at + BLOCK]
        try:
            out.append(coder.decompress(part))
        except zlib.error as e:
            raise ValueError(f"member is damaged: {e}") from None
        size += len(out[-1])
        at += len(part) - len(coder.unused_data)
        if coder.eof:
            return b"".join(out), at
        if size > MOST_RECORD_BYTES:
            raise ValueError("member is too long")


def _plain(view: _Window) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at the start of the window: its headers are read, then what they ask for, and all is checked once."""
    seen = 0
    while (end := view.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        # headers that do not end before the next record begins are damaged
        if _VERSION.search(view.data, max(1, seen - 10)) or len(view.data) > MOST_RECORD_BYTES:
            break
        seen = len(view.data)
        if not view.more():
            break
    head = re.match(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?content-length:\s*(\d{1,18})\r\n", view.data[: max(0, end) + 2], re.I)
    if head:
        whole = end + 8 + int(head[1])
        while len(view.data) < whole <= MOST_RECORD_BYTES and view.more():
            pass
    return parse(view.data)


def _next_start(view: _Window, at: int) -> int | None:
    """Where the next record can begin at or after ``at``; None at the end."""
    while True:
        line = _VERSION.search(view.data, at)
        found = [x for x in (view.data.find(MAGIC, at), line.start() if line else -1) if x >= 0]
        if found:
            return min(found)
        at = max(at, len(view.data) - 9)
        if not view.more():
            return None


def salvage(source: BinaryIO) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, compressed or not, in file order."""
    view, gap, reason = _Window(source), None, ""
    while True:
        if not view.data and not view.more():
            break
        while len(view.data) < 10 and view.more():
            pass
        try:
            if view.data[:3] == MAGIC:
                data, size = _inflate(view)
                headers, block, used = parse(data)
                if used != len(data):
                    raise ValueError("bytes follow the record in its member")
            else:
                headers, block, size = _plain(view)
        except ValueError as e:
            if gap is None:
                gap, reason = view.base, str(e)
            start = _next_start(view, 1)
            view.drop(len(view.data) if start is None else start)
            continue
        if gap is not None:
            yield Gap(gap, view.base, reason)
            gap = None
        yield Record(view.base, headers, block)
        view.drop(size)
    if gap is not None:
        yield Gap(gap, view.base, reason)


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: null where the page's own payload is stored.

    Of pages with equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes the
    one with the smallest page_id is stored and the others refer to it. Only
    digests with several pages take part in the join, and counting combines on
    the map side, so a hot payload does not gather in a task; the join's pages
    side is one that Spark can split. Pages that share the smallest id are all
    stored. A null id counts as the largest, and where a digest has null ids
    alone, all are stored.
    """
    # a page without a digest has a key of its own, which meets nothing, so that such pages do not gather in one task
    alone = F.concat(F.lit("none "), F.xxhash64("page_id", "url").cast("string"))
    digest = F.when(F.octet_length("html") >= LEAST_REVISIT_BYTES, F.sha2(F.encode("html", "UTF-8"), 256)).otherwise(alone)
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    first = rows.where("digest NOT LIKE 'none %'").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = first.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    joined = rows.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages and return the manifest (path, records, bytes), an archive a row.

    A task closes an archive once it holds ``archive_bytes`` and begins another.
    File names carry the attempt that wrote them, and only files that the
    manifest names count, so a retried task leaves no double records. A null
    html is empty; a null url leaves the target out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(out)
        files.create_dir(folder, recursive=True)
        own = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        sink, name, records, size, part = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [out.rsplit(folder, 1)[0] + name], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                if sink is None:
                    name, records, size, part = f"{own}-{part:04d}.warc.gz", 0, 0, part + 1
                    sink = files.open_output_stream(name)
                payload = (html.as_py() or "").encode()
                kind = "response" if refers_to.as_py() is None else "revisit"
                data = member(record(kind, f"urn:page:{page_id.as_py()}", url.as_py() or "", payload, hashlib.sha256(payload).hexdigest(), None if kind == "response" else f"urn:page:{refers_to.as_py()}"))
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Records and gaps of the archives that a table of paths names, an archive to a task at a time; see ``gap_log``.

    A task holds the record it reads, at most MOST_RECORD_BYTES, and its
    compressed bytes, and takes time in proportion to them.

    path, offset, record_id, record_type, uri, refers_to, payload_digest (as the
    record states it), payload_bytes (of the full payload, from the HTTP
    headers), payload (null for revisits), gap_end and gap_reason (for gaps
    alone, whose other columns are null).
    """
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string())]
        + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap_end", pa.int64()), ("gap_reason", pa.string())]
    )

    def row(path: str, x: Record | Gap) -> dict:
        if isinstance(x, Gap):
            return {"path": path, "offset": x.offset, "gap_end": x.end, "gap_reason": x.reason}
        head, _, payload = x.block.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)content-length:\s*(\d+)", head)
        kind = x.headers.get("warc-type")
        return {
            "path": path,
            "offset": x.offset,
            "record_id": x.headers.get("warc-record-id", "").strip("<>"),
            "record_type": kind,
            "uri": x.headers.get("warc-target-uri"),
            "refers_to": x.headers["warc-refers-to"].strip("<>") if "warc-refers-to" in x.headers else None,
            "payload_digest": x.headers.get("warc-payload-digest", "").removeprefix("sha256:"),
            "payload_bytes": int(length[1]) if length else len(payload),
            "payload": None if kind == "revisit" else payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_stream(name) as source:
                    for x in salvage(source):
                        rows.append(row(path, x))
                        size += len(rows[-1].get("payload") or b"")
                        if size > 4 * BLOCK or len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "path string, offset long, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap_end long, gap_reason string"
    archives = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(archives, "path").mapInArrow(run, ddl)


def gap_log(read: DataFrame) -> DataFrame:
    """path, offset, gap_end, gap_reason of all gaps of ``read_archives``, as a written table of the shared folder."""
    return written(read.where("gap_end IS NOT NULL").select("path", "offset", "gap_end", "gap_reason"), "warc-gaps")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as the archives hold them.

    Null and empty html count as an empty payload; such pages, short ones, ties
    and repeated rows follow ``with_references``. Whole payloads are written and
    read, however long. An empty table gives no rows. Other columns are ignored.
    For stored payloads length and digest are taken from the bytes read back.
    The archives were written by this call, so a gap in one of them fails the
    query instead of losing a page.
    """
    spark = pages.sparkSession
    manifest = write_archives(with_references(pages), new_path(spark, "warc"))
    gap = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", F.lit("at byte"), "offset", "gap_reason"))
    read = read_archives(spark, manifest).where(F.when(F.col("gap_end").isNotNull(), gap.cast("boolean")).otherwise(F.lit(True)))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    stored = F.col("payload").isNotNull()
    return read.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


#: Groups whole payloads, not digests, so that it does not share the operator's way of finding copies.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
stored AS (SELECT h, min(page_id) AS first_id FROM p WHERE strlen(h) >= 100 GROUP BY h),
j AS (SELECT page_id, h, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p LEFT JOIN stored USING (h))
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""
