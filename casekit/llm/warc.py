"""Operator 6: WARC transactions: written, read back and assembled by concurrent-to ids.

A capture is three records: the response (or a revisit, where an earlier capture had
the same payload), the request and the metadata; the latter two name the first in
WARC-Concurrent-To. Every record is a gzip member of its own. Reading parses records
from the archives, each archive once, and brings those of one capture together by that id into one nested row per
capture, wherever in the archives they stand.

A record's id is made from the page's id and its row number in the input, so that a revisit can name the record it
refers to (WARC-Refers-To), whichever archive has it. The pages are read twice and must have the same order each time:
a stored table has it, another frame should be checkpointed first.

Defined results: a null payload is empty; a null URL is written without WARC-Target-URI and read back as null;
repeated ids are captures of their own; of several rows with a payload's smallest id all are responses, and
revisits refer to the first; a capture whose request or metadata record is missing has nulls there, records whose
capture is missing are left out; an empty table gives no archive and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import maybe_broadcast, new_folder, one_task_each, open_fs, write_parts
from casekit.session import cut_lineage

#: Shorter payloads are always written in full.
REVISIT_BYTES = 100
#: Every capture gets this date: the input has none.
DATE = "1970-01-01T00:00:00Z"
TOP, SIDE = ("response", "revisit"), ("request", "metadata")
RECORD = ("record_id string, concurrent_to string, warc_type string, target_uri string, payload_digest string, "
          "refers_to string, block binary, payload binary, payload_length long, payload_sha256 string")
#: Bytes read from an archive at once. What follows a member in them is copied once per member, so that
#: large pieces cost more than the reads they save.
PIECE = 1 << 15
#: Blocks up to this size are compressed with a small window and small tables, which are made faster.
SMALL_BLOCK = 1 << 10
_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
_KINDS = pa.schema([(n, _TYPES[kind]) for n, kind in (c.split() for c in RECORD.split(", "))])
#: Fixed names of the format.
FIELDS = {"warc-record-id": "record_id", "warc-concurrent-to": "concurrent_to", "warc-type": "warc_type",
          "warc-target-uri": "target_uri", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(row: str, kind: str) -> str:
    """Record id: a digest of the capture's key, so that a repeated task writes the same bytes and a revisit
    finds its response's id."""
    h = hashlib.blake2b(f"{kind}:{row}".encode(), digest_size=16).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    pack = zlib.compressobj(1, zlib.DEFLATED, 26, 2) if len(block) <= SMALL_BLOCK else zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def capture_records(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
                    refers_to: int | None, refers_key: str | None = None) -> Iterator[bytes]:
    """The three records of one capture; ``refers_key`` is the key of the capture that a revisit refers to."""
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    me = _uri(key, "response")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    more = [] if refers_to is None else [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(refers_key, "response"))]
    yield _member([("WARC-Type", kind), ("WARC-Record-ID", me), *common, ("WARC-Payload-Digest", f"sha256:{digest}"),
                   *more, ("Content-Type", "application/http; msgtype=response")],
                  http + (payload if refers_to is None else b""))
    yield _member([("WARC-Type", "request"), ("WARC-Record-ID", _uri(key, "request")), *common,
                   ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request")],
                  f"GET {url or '/'} HTTP/1.1\r\n\r\n".encode())
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    fields += f"payload-length: {len(payload)}\r\n" + ("" if refers_to is None else f"refers-to-page: {refers_to}\r\n")
    yield _member([("WARC-Type", "metadata"), ("WARC-Record-ID", _uri(key, "metadata")), *common,
                   ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields")], fields.encode())


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a capture per row of ``pages(page_id, url, html)``. Of captures with equal payloads of at
    least ``least`` bytes that with the smallest id is the response, the others revisit it.
    Every input partition writes its own archive. Returns the manifest ``part, path, n_records``."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"),
                     F.monotonically_increasing_id().alias("row"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    # first captures by digest: only digests that several captures share need a look-up, and only
    # digests and ids are grouped, so a payload that a third of the pages has is folded map-side
    seen = (p.where(F.length("payload") >= least).groupBy("digest")
            .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"),
                 F.count("*").alias("n")).where("n > 1").drop("n"))
    p = p.join(maybe_broadcast(cut_lineage(seen)), "digest", "left")
    refers = F.when((F.length("payload") >= least) & (F.col("page_id") > F.col("first.page_id")), F.col("first"))
    p = p.select("page_id", "url", "payload", "digest", "row", refers["page_id"].alias("refers_to"),
                 refers["row"].alias("refers_row"))

    def part(out, batches):
        n = 0
        for b in batches:
            for r in b.to_pylist():
                refers_key = None if r["refers_to"] is None else f"{r['refers_to']}:{r['refers_row']}"
                for x in capture_records(f"{r['page_id']}:{r['row']}", r["page_id"], r["url"], r["payload"], r["digest"],
                                         r["refers_to"], refers_key):
                    out.write(x)
                    n += 1
        return (n,)

    return write_parts(p, folder, ".warc.gz", part, "n_records long")


class _Stream:
    """The bytes of concatenated gzip members, decompressed piece by piece."""

    def __init__(self, file):
        self.file, self.buf, self.zip = file, b"", zlib.decompressobj(31)

    def _fill(self) -> bool:
        data = self.zip.unused_data if self.zip.eof else self.file.read(PIECE)
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
            data = data or self.file.read(PIECE)
        if not data:
            return False
        parts = [self.buf, self.zip.decompress(data)]
        while self.zip.eof and self.zip.unused_data:
            rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            parts.append(self.zip.decompress(rest))
        self.buf = b"".join(parts)
        return True

    def until(self, end: bytes) -> bytes | None:
        while (i := self.buf.find(end)) < 0:
            if not self._fill():
                return None
        out, self.buf = self.buf[:i], self.buf[i + len(end):]
        return out

    def take(self, n: int) -> bytes:
        held = io.BytesIO()
        while held.tell() < n:
            if not self.buf and not self._fill():
                raise ValueError("archive ends inside a record")
            more = min(len(self.buf), n - held.tell())
            held.write(self.buf[:more])
            self.buf = self.buf[more:]
        return held.getvalue()


def parse_records(file) -> Iterator[dict]:
    """Records of one archive, one at a time."""
    s = _Stream(file)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = s.take(int(fields["content-length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        record = {FIELDS[k]: v for k, v in fields.items() if k in FIELDS} | {"block": block}
        if fields["warc-type"] in TOP:  # the block is an HTTP message
            payload = record["payload"] = block.partition(b"\r\n\r\n")[2]
            record |= {"payload_length": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
        yield record


def read_records(manifest: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The records in the archives, less the columns ``without``. These are left out in the tasks that read, so that
    they are neither passed to Spark nor held; a payload's length and digest are taken there too. Requests, metadata and
    unknown records have no payload, responses and revisits no block (it is the payload once more)."""
    kinds = pa.schema([f for f in _KINDS if f.name not in without])
    columns = ", ".join(c for c in RECORD.split(", ") if c.split()[0] not in without)

    def task(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_stream(at, compression=None) as file:
                    rows, held = [], 0
                    for r in parse_records(file):
                        if r["warc_type"] in TOP:
                            r["block"] = None
                        r = {name: r.get(name) for name in kinds.names}
                        rows.append(r)
                        held += len(r.get("payload") or b"") + len(r.get("block") or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return one_task_each(manifest).mapInArrow(task, columns)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, target_uri, response{type, digest, [payload,] length, sha256,
    refers_to}, request{record_id, block}, metadata{record_id, page_id, payload_length, refers_to_page}``. All records of a
    capture come together by one grouping: a response or revisit by its own id, a request or metadata record by
    the id its WARC-Concurrent-To names. ``payload`` is there if ``records`` has it."""
    top = F.col("warc_type").isin(*TOP)
    content = ["payload"] if "payload" in records.columns else []
    field = lambda name: F.regexp_extract(F.decode("block", "UTF-8"), rf"(?m)^{name}: (-?[0-9]+)\r?$", 1).try_cast("long")
    response = F.struct(
        F.col("warc_type").alias("type"), F.regexp_extract("payload_digest", "^sha256:(.*)$", 1).alias("digest"), *content,
        F.col("payload_length").alias("length"), F.col("payload_sha256").alias("sha256"), "refers_to")
    metadata = F.struct("record_id", field("page-id").alias("page_id"), field("payload-length").alias("payload_length"),
                        field("refers-to-page").alias("refers_to_page"))
    r = records.where(F.col("warc_type").isin(*TOP, *SIDE)).select(
        F.when(top, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture"),
        F.when(top, F.struct("target_uri", response.alias("response"))).alias("top"),
        F.when(F.col("warc_type") == "request", F.struct("record_id", "block")).alias("request"),
        F.when(F.col("warc_type") == "metadata", metadata).alias("metadata"))
    # first, not min: a capture has one record of each type, and no payloads need comparing
    g = r.groupBy(F.col("capture").alias("record_id")).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("top", "request", "metadata")])
    return g.where("record_id IS NOT NULL AND top IS NOT NULL").select(
        "record_id", "top.target_uri", "top.response", "request", "metadata")


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` as archives and returns its captures as read back and assembled, without the payloads
    themselves (but with their lengths and digests) if not ``payloads``."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return assemble(read_records(manifest, () if payloads else ("payload",)))
