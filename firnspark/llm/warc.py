"""WARC archives in dictionary-compressed Zstandard: a writer on executors and a reader.

Each archive starts with a skippable frame that holds a dictionary built from the archive's own
records; every record follows as a frame of its own, compressed with that dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnspark.llm.common import Scratch

#: Format constants: the skippable frame that marks a dictionary, Zstandard's own magic, the revisit profile.
DICT_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, intact boolean, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of page refers_to without the payload."""
    named = "unknown" if page_id is None else str(page_id)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{named}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{named}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields; intact says whether lengths and, for a response, the digest hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:x-page:").rstrip(">")).lstrip("-").isdigit() else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    intact = rest[len(block) :] == b"\r\n\r\n"
    if kind == "response":
        intact = intact and len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "intact": intact, "payload": payload if kind == "response" else None,
    }


def dictionary(records: list[bytes], size: int, most: int) -> bytes:
    """A dictionary from records spread over the archive, of about `most` bytes together.

    Too little to learn from gives the first record's bytes as a raw dictionary.
    """
    every = max(1, -(-sum(map(len, records)) // most))
    try:
        return zstandard.train_dictionary(size, records[::every], k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return records[0][:size] if len(records[0]) >= 8 else records[0].ljust(8)


def archive(records: list[bytes], level: int = 3, dict_size: int = 64 << 10, train_on: int = 4 << 20) -> bytes:
    trained = dictionary(records, dict_size, train_on)
    packed = zstandard.ZstdCompressor(level=level).compress(trained)
    one = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return b"".join([struct.pack("<II", DICT_FRAME, len(packed)), packed, *map(one.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        trained = data[8 : 8 + size]
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(trained) if trained[:4] == ZSTD_MAGIC else trained)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view, step = memoryview(data), 1 << 16
    while at < len(data):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a frame")
            fed = view[at : at + step]
            out.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(out)


def revisits(pages: DataFrame, min_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that repeat a payload held by a larger page_id.

    Only digests are shuffled; counts per digest are summed before the shuffle, so a payload that
    a third of all pages share is one row per task.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    seen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("size"))
    last = seen.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return seen.where(F.col("size") >= min_bytes).join(last.drop("n"), "sha1").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, to: str, scratch: Scratch, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every page as a record into archives below the folder `to`; return the manifest (archive, records, bytes).

    `to` is a URI that pyarrow's filesystems reach from the executors (file, hdfs, s3, gs). An
    archive holds about archive_bytes of records of one task. Names are unique to the attempt, and
    only archives in the manifest count, so a lost or repeated task leaves nothing wrong behind.

    Of records with equal payloads of min_bytes or more, those of the largest page_id are responses
    and the others revisit it; shorter payloads are always responses. A null payload is empty, a
    null url is replaced by an urn, a null page_id is kept and never referred to (a repeat of it is a
    response). Repeated rows are repeated records. Other columns are not read. No pages: no archives.
    """
    again = scratch.keep(revisits(pages, min_bytes, id_col, payload_col), "revisits")
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("html"), F.sha1(F.encode(text, "UTF-8")).alias("sha1"))
    rows = rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(to)
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(held)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            done = pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)], "bytes": [len(data)]})
            held.clear()
            return done

        size = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                held.append(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py(), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return scratch.keep(rows.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, at: str, payload: bool = True) -> DataFrame:
    """The records of the manifest's archives: RECORDS, without the payload on request."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(at).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows = []
                for raw in frames(content.as_buffer().to_pybytes()):
                    rows.append(parsed(raw) | {"archive": name.as_py()})
                    if not payload:
                        rows[-1]["payload"] = None
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.join(manifest.select("archive"), "archive", "left_semi").select("archive", "content").mapInArrow(run, RECORDS)
