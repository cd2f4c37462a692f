"""WARC archives of Zstandard frames: one frame for each record, and a dictionary in a leading skippable frame.

The writer puts a record for each page into archives of about ARCHIVE bytes in the shared folder; equal payloads of at least
`least` bytes are stored once (response), the others refer to it (revisit). A manifest names the archives of tasks that
succeeded, so what a lost task left is never read. The reader loads the dictionary, finds each frame by its block headers,
decodes it alone, and checks versions, mandatory fields, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm._filters import join_groups, key_filter, maybe_in
from sparkwarden.llm._shared import new_path, stored

ARCHIVE = 64 << 20
LEAST = 1000
#: Fixed values of the Zstandard format and of .warc.zst files.
FRAME_MAGIC, DICTIONARY_FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 200, 4 << 10
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that doesn't keep to the format."""


def uri_of(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {uri_of(url)}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record: header, HTTP head and, in a response, the payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", DATE), ("WARC-Target-URI", uri_of(url)), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", uri_of(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from some of an archive's records; none if they are too few or too small."""
    parts = [s[:SAMPLE_BYTES] for s in samples[:SAMPLES]]
    if len(parts) < 16 or sum(map(len, parts)) < 4 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=200, d=8)
    except zstandard.ZstdError:
        return None


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, by its block headers."""
    try:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME_MAGIC:
            end, last = at + zstandard.frame_header_size(bytes(data[at : at + 18])), 0
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise WarcError(f"byte {at}: the frame is cut off")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise WarcError(f"byte {at}: a reserved block type")
                end += 3 + (1 if kind == 1 else size)
            end += 4 if data[at + 4] & 4 else 0
        else:
            raise WarcError(f"byte {at}: no Zstandard frame")
    except struct.error as e:
        raise WarcError(f"byte {at}: the frame is cut off") from e
    if end > len(data):
        raise WarcError(f"byte {at}: the frame is cut off")
    return end


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header field: {line!r}")
        fields[name] = value.strip()
    if missing := [m for m in MANDATORY if m not in fields]:
        raise WarcError(f"missing {missing}")
    if not fields["Content-Length"].isdecimal() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length isn't the block's length")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    return fields, http, payload


def page_of(fields: dict[str, str], http: bytes, payload: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's payload must have the named length and digest."""
    kind = fields["WARC-Type"]
    named = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if kind not in ("response", "revisit") or len(named) != 1:
        raise WarcError(f"no page record: {kind}")
    size, (algorithm, _, digest) = int(named[0]), fields.get("WARC-Payload-Digest", "").partition(":")
    hexed = base64.b32decode(digest).hex() if algorithm == "sha1" else ""
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != hexed):
        raise WarcError("the payload hasn't the length and digest of its header")
    if kind == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-Id"), size, hexed, kind, number("X-Refers-To-Page-Id")


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """All records of an archive."""
    view, at, own = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        at = frame_end(view, 0)
        content = bytes(view[8:at])
        if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
            content = zstandard.ZstdDecompressor().decompress(content)
        own = zstandard.ZstdCompressionDict(content)
    decoder = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME_MAGIC:
            yield parse(decoder.decompressobj().decompress(bytes(view[at:end])))  # a frame need not name its size
        at = end


class _Archive:
    """An archive being written; the first records wait until the dictionary is trained on them."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.fs.create_dir(base, recursive=True)
        self.path, self.uri = f"{base}/{name}", f"{folder}/{name}"
        self.waiting: list[bytes] = []
        self.out, self.encoder, self.raw, self.records = None, None, 0, 0

    def add(self, raw: bytes) -> None:
        self.raw += len(raw)
        self.records += 1
        if self.encoder is None:
            self.waiting.append(raw)
            if len(self.waiting) >= SAMPLES:
                self.begin()
        else:
            self.out.write(self.encoder.compress(raw))

    def begin(self) -> None:
        self.out = self.fs.open_output_stream(self.path, compression=None)
        own = trained(self.waiting)
        if own:
            self.out.write(dictionary_frame(own.as_bytes()))
            own.precompute_compress(level=3)
        self.encoder = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True) if own else zstandard.ZstdCompressor(level=3, write_content_size=True)
        for raw in self.waiting:
            self.out.write(self.encoder.compress(raw))
        self.waiting = []

    def close(self) -> dict:
        if self.encoder is None:
            self.begin()
        self.out.close()
        return {"archive": [self.uri], "records": [self.records], "raw_bytes": [self.raw]}


def _write(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, number = TaskContext.get(), None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "record_type", "refers_to", "refers_url"))):
                if archive is None:
                    archive = _Archive(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst")
                    number += 1
                page_id, url, html, kind, refers_to, refers_url = (x.as_py() for x in row)
                archive.add(record(page_id, url, (html or "").encode(), kind, refers_to, refers_url))
                if archive.raw >= ARCHIVE:
                    yield pa.RecordBatch.from_pydict(archive.close())
                    archive = None
        if archive is not None:
            yield pa.RecordBatch.from_pydict(archive.close())

    return run


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) to archives; the manifest (archive, records, raw_bytes), stored.

    Of equal payloads of at least `least` bytes the record of the largest page_id is the response (null ids are smallest; repeated
    rows of that id are responses each), the others are revisits. Null html is an empty payload, null url `about:blank`.
    """
    # payloads are equal if their lengths and SHA-256 are
    key = F.concat_ws("-", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256), F.octet_length("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("equal", key)
    large = rows.where(F.octet_length("html") >= least).groupBy("equal").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count(F.lit(1)).alias("n"))
    groups = stored(large.where("n > 1 and response.page_id is not null").select("equal", "n", F.col("response.page_id").alias("response"), F.col("response.url").alias("refers_url")), "equal-payloads")
    marked = maybe_in(rows.withColumn("_sw_key", F.col("equal")), "_sw_key", key_filter(groups, "equal"))
    alone = marked.where("not _sw_maybe").select("page_id", "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    found = join_groups(marked.where("_sw_maybe"), groups, "equal", "n", groups.agg(F.sum("n")).first()[0] or 0, "left")
    maybe = found.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"), F.when(again, F.col("refers_url")).alias("refers_url"))
    folder = new_path(pages.sparkSession, "warc")
    return stored(alone.unionByName(maybe).mapInArrow(_write(folder), "archive string, records long, raw_bytes long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, count in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
            fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
            with fs.open_input_file(path) as f:
                data = f.read()
            found = [page_of(*r) for r in read_archive(data)]
            if len(found) != count:
                raise WarcError(f"{uri}: {len(found)} records, {count} were written")
            columns = list(zip(*found))
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(columns[0], pa.int64()), "payload_bytes": pa.array(columns[1], pa.int64()), "payload_digest": pa.array(columns[2], pa.string()), "record_type": pa.array(columns[3], pa.string()), "refers_to": pa.array(columns[4], pa.int64())})


def read_pages(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to of all records of the archives in a manifest."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "archive").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back. An empty table gives no archive and no rows."""
    return read_pages(write_archives(pages))


ORACLE = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY html)
"""
