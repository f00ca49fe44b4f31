"""WARC records in seekable Zstandard bundles: write, read back, and fetch single records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalift.functions.names import scratch_dir

from .common import store

# Fixed values of the seekable format and of the records.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
#: Equal payloads from this size on are written once.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
#: Tasks that bundles are read in at most.
READ_TASKS = 20_000
#: Bytes that the number of frames and the magic number take at the end of a bundle.
FOOTER = 9

INDEX = "page_id long, record_id string, record_type string, file string, frame int, offset int, length long"
RECORDS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


# --- one record -----------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def page_of(record: str | None) -> int | None:
    return int(record[9:]) if record and record.startswith("urn:page:") else None


def encode_record(name, url, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """A response with its payload, or a revisit that keeps the HTTP header alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(refers_to)}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def decode_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the place after it; a bad record is an error."""
    end = data.index(b"\r\n\r\n", at)
    if data[at : at + 9] != b"WARC/1.1\r":
        raise ValueError(f"no record at {at}")
    fields = _fields(data[at:end])
    start, size = end + 4, int(fields["content-length"])
    block = data[start : start + size]
    if len(block) != size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    n_bytes = int(_fields(http)["content-length"])
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n_bytes):
        raise ValueError(f"payload of the record at {at} does not match its digest")
    name = fields["warc-record-id"][1:-1]
    row = {
        "record_id": name,
        "page_id": page_of(name),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"][1:-1]) if revisit else None,
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }
    return row, start + size + 4


# --- one bundle -----------------------------------------------------------------------


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, read from the footer; the end of a bundle from
    its seek table on will do."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the bundle")
    found, at, table = [], 0, len(bundle) - 9 - 8 * n
    for i in range(n):
        packed, plain = struct.unpack_from("<II", bundle, table + 8 * i)
        found.append((at, packed, plain))
        at += packed
    return found


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


class _Bundles:
    """Writes the bundles of one task. Names are new for each attempt, and only the index of
    the attempt that Spark commits points at them: a lost or repeated task harms nothing."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        import zstandard
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self._open()

    def _open(self):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.written, self.frames, self.buffer = [], 0, [], bytearray()

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.written >= self.bundle_bytes:
            self.close()
            self._open()
        place = self.name, len(self.frames), len(self.buffer)
        self.buffer += record
        if len(self.buffer) >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self):
        if self.buffer:
            packed = self.pack(bytes(self.buffer))
            self.frames.append((len(packed), len(self.buffer)))
            self.out.append(packed)
            self.written += len(packed)
            self.buffer = bytearray()

    def close(self):
        self._frame()
        if self.frames:
            with self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None) as f:
                f.write(b"".join([*self.out, seek_table(self.frames)]))


# --- all records ----------------------------------------------------------------------


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archives(
    pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; return the
    index: record, file, frame, offset within the plain frame, length.

    Of equal payloads of at least ``REVISIT_BYTES`` the row with the largest page_id is a
    response, the others revisit it. Rows that share that page_id are all responses; rows
    without page_id are responses too and are named by a random id. A null html is an empty
    payload, a null url leaves its field out, other columns are ignored, an empty table
    writes nothing. Frames have 32-bit sizes, so a record of 4 GB or more is an error; Spark's
    own rows end at 2 GB. ``folder`` must be shared by all executors (any store pyarrow can write).
    """
    page = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"))
    page = page.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    large = (F.col("n_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    # payloads that occur once need no partner and do not travel
    groups = page.where(large).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = store(groups.where("n > 1").select(F.col("digest").alias("same"), "first"))
    # small payloads get keys of their own, so that a common one does not meet in one task
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("digest"))))
    page = page.withColumn("same", key).join(groups, "same", "left")
    page = page.withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("same", "first")
    target = _uri(folder)

    def write(batches):
        import pyarrow as pa

        bundles = _Bundles(target, frame_bytes, bundle_bytes)
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                name = record_id(r["page_id"])
                record = encode_record(name, r["url"], r["payload"], r["digest"], r["n_bytes"], r["refers_to"])
                file, frame, offset = bundles.add(record)
                kind = "response" if r["refers_to"] is None else "revisit"
                out.append((r["page_id"], name, kind, file, frame, offset, len(record)))
            columns = list(zip(*out)) or [()] * len(names)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        bundles.close()

    return store(page.mapInArrow(write, INDEX))


def _dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of an index dealt by bundle to about a task for each bundle, at most ``READ_TASKS``."""
    n = rows.agg(F.approx_count_distinct("file")).first()[0]
    return rows.repartition(max(1, min(READ_TASKS, n)), "file")


class _Bundle:
    """A bundle read by ranges: the footer first, then single frames."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self._range(max(0, size - FOOTER), size)
        n = struct.unpack("<I", tail[-9:-5])[0]
        self.frames = frames_of(self._range(max(0, size - 9 - 8 * n), size))

    def _range(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return read_frame(self._range(start, start + packed), (0, packed, plain))

    def close(self):
        self.file.close()


def _records(rows: list[dict]):
    import pyarrow as pa

    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types))))


def read_archives(spark: SparkSession, index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles of an index, checked against its digest; without
    ``payloads`` they are read and checked but not returned.

    Tasks open the bundles that the index names and read them frame by frame: a task holds one
    frame at a time, and no name reaches the driver. Files that no index names are not opened,
    so what a lost task left behind does no harm. An empty index gives no rows.
    """
    target = _uri(folder)

    def parse(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                bundle = _Bundle(target, name)
                for k in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        row, at = decode_record(data, at)
                        rows.append(row if payloads else row | {"payload": None})
                    yield _records(rows)
                bundle.close()

    return _dealt(spark, index.select("file").distinct()).mapInArrow(parse, RECORDS)


def fetch(spark: SparkSession, index: DataFrame, folder: str, record_ids: list[str]) -> DataFrame:
    """Single records by id: of their bundles only the footer and the frames that hold them are
    read. An id that the index lacks gives no row; an id asked for twice gives one."""
    target = _uri(folder)
    wanted = index.where(F.col("record_id").isin(record_ids)).select("file", "frame", "offset")

    def seek(batches):
        from itertools import groupby

        for batch in batches:
            places = sorted((r["file"], r["frame"], r["offset"]) for r in batch.to_pylist())
            for name, own in groupby(places, lambda p: p[0]):
                bundle = _Bundle(target, name)
                for k, inside in groupby(own, lambda p: p[1]):
                    data = bundle.frame(k)
                    yield _records([decode_record(data, at)[0] for _, _, at in inside])
                bundle.close()

    return _dealt(spark, wanted).mapInArrow(seek, RECORDS)


def roundtrip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back, and say what each record was read as."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark)
    index = write_archives(pages, folder)
    return read_archives(spark, index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
