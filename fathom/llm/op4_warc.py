"""WARC archives under Zstandard: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record follows as one frame of its own. The reader loads that
dictionary, decodes frame by frame in a stream, and validates each record: the
version line, the mandatory headers, the block's length, the block digest, and
the payload digest of records that carry their payload. A revisit carries the
HTTP headers of its capture, so the length of the full payload is known, and
names the response that it revisits.

Archives are files in a shared folder. A task writes under a name of its own
attempt and renames when done; the rows that say which archives belong to the
result come from the attempts that Spark committed, so a lost executor or a
second attempt leaves at most a file that nobody reads.

Which capture is the response: of records with equal payloads (by SHA-1 and
length) that have ``min_bytes`` or more, the one with the largest id; the others
revisit it. The largest ids are a pre-aggregated maximum, so one payload in a
third of all rows costs no more than a skewed join that Spark splits.

Defined cases: null html is an empty payload; a null id ranks below all ids and
is written as ``null``; rows that repeat the largest id are all responses; a
null url is written as ``urn:unknown``; a very long payload is one record, held
whole by its task; extra columns are ignored; an empty table gives no archive. The
archives stay in the shared folder, as the result is read from them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_arrow, prepare, shared_dir, table, utf8

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Archives are closed at about this many bytes of records.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on so many bytes of an archive's first records.
DICT_SAMPLE_BYTES, DICT_BYTES = 2 << 20, 64 << 10
#: Tasks that read archives at a time.
READERS = 10_000
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit leaves the payload out."""
    target = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass") + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers and payload of a record; raises WarcError on any breach."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the header doesn't end")
    lines = data[:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError(f"version line {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line[:40]!r}")
        headers[name.decode("ascii", "strict").strip()] = value.strip().decode("utf-8", "surrogatepass")
    if missing := [h for h in MANDATORY if h not in headers]:
        raise WarcError(f"no {missing[0]}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    n = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(data) - end - 8} bytes, not {n}")
    if (want := headers.get("WARC-Block-Digest")) and want != "sha1:" + base32_sha1(block):
        raise WarcError("block digest")
    kind = headers["WARC-Type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"), None)
    if kind == "response":
        if length != len(payload):
            raise WarcError(f"the payload has {len(payload)} bytes, not {length}")
        if (want := headers.get("WARC-Payload-Digest")) and want != "sha1:" + base32_sha1(payload):
            raise WarcError("payload digest")
    elif kind == "revisit" and "WARC-Refers-To" not in headers:
        raise WarcError("no WARC-Refers-To")
    return {"type": kind, "headers": headers, "payload": payload, "payload_length": length}


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the records, or none (empty) where there are too few to train one."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes the dictionary frame, then each record as a frame."""

    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out = out
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        frame = zstandard.ZstdCompressor(level=level).compress(dictionary) if dictionary else b""
        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(frame)) + frame)

    def write(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))


def read_archive(source, chunk: int = 1 << 20, step: int = 16 << 10) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; holds a frame and a chunk, of which a frame's end copies a step at most."""
    head = _exactly(source, 8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise WarcError("no dictionary frame in front")
    frame = _exactly(source, size)
    dictionary = b""
    if frame:
        dictionary = zstandard.ZstdDecompressor().decompress(frame) if frame[:4] == zstandard.FRAME_HEADER else frame
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held, at = memoryview(source.read(chunk)), 0
    while len(held):
        frame_reader, record = decompressor.decompressobj(), io.BytesIO()
        while not frame_reader.eof:
            if at >= len(held):
                held, at = memoryview(source.read(chunk)), 0
                if not len(held):
                    raise WarcError("the last frame is cut off")
            piece = held[at : at + step]
            record.write(frame_reader.decompress(piece))
            at += len(piece) - len(frame_reader.unused_data if frame_reader.eof else b"")
        yield record.getvalue()
        if at >= len(held):
            held, at = memoryview(source.read(chunk)), 0


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise WarcError("the archive is cut off")
    return data


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and what each page is written as: ``revisit`` and ``refers_to``."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("len"))
    first = cut(keyed.groupBy("sha", "len").agg(F.max("page_id").alias("response")))
    same = keyed.join(first, ["sha", "len"])
    revisit = F.coalesce((F.col("len") >= min_bytes) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.lit(False))
    return same.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a path or an address."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; gives their paths and record counts. The rows are cut, so writing happens once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        held: list[bytes] = []
        size, out, writer, name, n, written = 0, None, None, "", 0, []

        def start():
            nonlocal out, writer, name, n, size
            sample, total = [], 0
            for r in held:
                if total > DICT_SAMPLE_BYTES:
                    break
                sample.append(r[: 128 << 10])
                total += len(r)
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            out = system.open_output_stream(name + ".part", compression=None)
            writer, n = ArchiveWriter(out, train(sample)), 0

        def flush():
            nonlocal n
            if writer is None:
                start()
            for r in held:
                writer.write(r)
            n += len(held)
            held.clear()

        def close():
            nonlocal writer, size
            flush()
            out.close()
            system.move(name + ".part", name)
            written.append((name, n))
            writer, size = None, 0

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                record = build_record(page_id, url, utf8(html), refers_to, revisit)
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    close()
                elif size >= 2 * DICT_SAMPLE_BYTES:
                    flush()
        if held or writer is not None:
            close()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written]), pa.array([w[1] for w in written], pa.int64())], ["path", "n_records"])

    return cut(map_arrow(roles(pages, min_bytes), run, "path string, n_records long"))


def read(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives at ``path``: id, type, headers that matter, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, want in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                rows, size, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        r = parse_record(raw)
                        h = r["headers"]
                        n += 1
                        rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), r["payload_length"], h["WARC-Payload-Digest"].removeprefix("sha1:"), r["type"], _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, r["payload"] if with_payload else None))
                        size += len(raw) if with_payload else 200
                        if size >= 4 << 20:
                            yield _rows(rows, schema)
                            rows, size = [], 0
                if n != want:
                    raise WarcError(f"{path} has {n} records, not {want}")
                if rows:
                    yield _rows(rows, schema)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # a task per archive, up to READERS tasks: the rows are few and small, so adaptive execution would join them
    n = max(1, min(archives.count(), READERS))
    number = F.row_number().over(Window.orderBy("path"))  # one row per archive of 64 MB
    return map_arrow(archives.withColumn("_to", F.pmod(number, F.lit(n)).cast("int")).repartitionById(n, F.col("_to")).select("path", "n_records"), run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write(table(spark, sf_dir, "pages"), folder)
    return read(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base 32 takes 8 characters for 10 hexadecimal digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(url, 'urn:unknown') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, strlen(html) AS n, max(page_id) AS response FROM p GROUP BY 1, 2),
j AS (SELECT p.*, response, response IS NOT NULL AND page_id IS DISTINCT FROM response AS again FROM p JOIN r ON p.h = r.h AND strlen(html) = n)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (10 * (k // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN response END AS refers_to, url FROM j
"""
