"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writer: one record for each page, each record a gzip member of its own. Of records with equal payloads of at least
``MIN_REVISIT`` bytes, the one with the largest page id is a ``response``, the others are ``revisit`` records without
payload that refer to it; smaller payloads are all responses. Records are compressed where the page is read, so only
compressed bytes are shuffled, once, to meet what their page refers to; the tasks of that join write the archives. Every attempt of a task writes a file of its own
and only the files that successful tasks name are archives, so a task that is run again leaves no double records.

Reader: files are cut into byte ranges. A task looks for the gzip magic in its range, checks a candidate by decoding the
start of the member up to a WARC version line, and owns the members that start inside; it reads on beyond its range to
the end of the last one. Magic bytes inside compressed data fail the check, or lie inside a member that is being read.

Files are opened by their URI through pyarrow's file systems (local and shared mounts, HDFS, object stores).

Cases: a null html is an empty payload; a null url writes no target; line breaks in a url are percent-coded; a null page
id takes no part; rows that repeat a page id each write a record, and equal payloads under one id stay responses; no
pages give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import rows_of
from corpusloom.session import work_dir

MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Bytes of a range, of one read, and of compressed data decoded to check a candidate.
RANGE, BLOCK, PROBE = 32 << 20, 1 << 20, 512
#: Pages of an archive at most; one record is held while it is written.
PAGES_PER_FILE = 20_000
DATE = "2000-01-01T00:00:00Z"
RECORDS = ("record_id string, record_type string, uri string, page_id long, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary, path string, offset long")


def _opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs, path


def _uri(base: str) -> str:
    """Spark's folder as a URI that pyarrow reads: file:/x and file:///x alike."""
    return "file://" + base[len("file:"):] if base.startswith("file:/") and not base.startswith("file://") else base


def record(kind: str, page_id: int, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = VERSION.decode() + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          pages_per_file: int = PAGES_PER_FILE) -> list[str]:
    """Write the archives below ``folder``; the URIs of the files, a short list."""
    base = _uri(folder)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).filter("id IS NOT NULL")
    named = rows.select("id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    # Only ids, sizes and digests meet to find equal payloads.
    large = named.select("id", "size", "digest").filter(F.col("size") >= MIN_REVISIT)
    first = large.groupBy("digest", "size").agg(F.max("id").alias("target"), F.min("id").alias("low")).filter("low < target")
    again = large.join(first, ["digest", "size"]).filter("id < target").select("id", "digest", "target").distinct()

    def compress(batches):
        for batch in batches:
            out = [
                (i, url, size, digest, record("response", i, url, size, digest, data, None))
                for i, url, data, size, digest in rows_of([batch], "id", "url", "payload", "size", "digest")
            ]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "url", "size", "digest", "member"])

    members = named.mapInArrow(compress, "id long, url string, size long, digest string, member binary")
    revisits = again.select(F.col("id").alias("of"), F.col("digest").alias("same"), "target")
    joined = members.join(revisits, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("same")), "left").select(
        "id", "url", "size", "digest", F.when(F.col("target").isNull(), F.col("member")).alias("member"), "target")

    def store(batches):
        sink, made, written = None, [], 0
        for i, url, size, digest, member, target in rows_of(batches, "id", "url", "size", "digest", "member", "target"):
            if sink is not None and written >= pages_per_file:
                sink.close()
                sink = None
            if sink is None:
                name = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                fs, path = _opened(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink, written = fs.open_output_stream(path, compression=None), 0
                made.append(name)
            sink.write(member if target is None else record("revisit", i, url, size, digest, None, target))
            written += 1
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return sorted(r["path"] for r in joined.mapInArrow(store, "path string").collect())


class _Window:
    """Bytes of a file from ``start`` on, read in blocks; what lies before the reader's place is let go."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start, self.size, self.data = source, start, size, b""

    def reach(self, end: int) -> None:
        while self.start + len(self.data) < min(end, self.size):
            at = self.start + len(self.data)
            self.data += self.source.read_at(min(BLOCK, self.size - at), at)

    def drop(self, at: int) -> None:
        if at - self.start >= BLOCK:
            self.data, self.start = self.data[at - self.start:], at

    def find(self, at: int, stop: int) -> int:
        """Place of the next magic that starts before ``stop``, or -1."""
        while at < min(stop, self.size):
            self.drop(at)
            upto = min(at + BLOCK, stop + len(MAGIC) - 1, self.size)
            self.reach(upto)
            found = self.data.find(MAGIC, at - self.start, upto - self.start)
            if found >= 0:
                return self.start + found
            at = max(at + 1, upto - len(MAGIC) + 1)
            if upto >= self.size:
                return -1
        return -1


def _is_record(window: _Window, at: int) -> bool:
    window.reach(at + PROBE)
    decoder = zlib.decompressobj(31)
    try:
        return decoder.decompress(window.data[at - window.start:at - window.start + PROBE], 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The whole member that starts at ``at`` and where it ends; None if it is damaged."""
    decoder, parts, place = zlib.decompressobj(31), [], at
    try:
        while not decoder.eof:
            if place >= window.size:
                return None
            window.reach(place + BLOCK)
            piece = window.data[place - window.start:place - window.start + BLOCK]
            parts.append(decoder.decompress(piece))
            place += len(piece)
    except zlib.error:
        return None
    return b"".join(parts), place - len(decoder.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[:int(fields.get("content-length", 0))]


def _page(reference: str | None) -> int | None:
    body = (reference or "").strip("<>")
    return int(body.rpartition(":")[2]) if body.startswith("urn:page:") else None


def records_in(uri: str, start: int, stop: int) -> Iterator[tuple]:
    """Rows of the records that start in [start, stop) of a file."""
    fs, path = _opened(uri)
    with fs.open_input_file(path) as source:
        window = _Window(source, start, source.size())
        at = window.find(start, stop)
        while at >= 0:
            found = _member(window, at) if _is_record(window, at) else None
            if found is None:
                at = window.find(at + 1, stop)
                continue
            data, end = found
            fields, block = parse(data)
            payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
            kind = fields.get("warc-type")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            size = int(fields.get("warc-payload-length", len(payload)))
            if kind == "response":
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
            yield (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), _page(fields.get("warc-record-id")), size, digest,
                   _page(fields.get("warc-refers-to")), payload, uri, at)
            at = window.find(end, stop)


def read(spark: SparkSession, files: list[str], range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives. A file is read by as many tasks as it has ranges."""
    ranges = []
    for uri in files:
        fs, path = _opened(uri)
        size = fs.get_file_info(path).size
        ranges += [(uri, a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
    table = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(max(1, len(ranges)))
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def scan(batches):
        out, held = [], 0
        for uri, a, b in rows_of(batches, "path", "start", "stop"):
            for row in records_in(uri, a, b):
                out.append(row if payloads else (*row[:7], None, *row[8:]))
                held += len(row[7])
                if held > 8 * BLOCK or len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return table.mapInArrow(scan, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id") -> DataFrame:
    """Write every page to archives, read them back; per page what the archives say."""
    spark = pages.sparkSession
    files = write(pages, folder or work_dir(spark, "warc"), id_col)
    return read(spark, files, payloads=False).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
