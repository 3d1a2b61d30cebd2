"""WARC archives in Zstandard: one frame per record, behind a dictionary in a skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
perhaps compressed; each record is one further frame. A writer task trains its archives'
dictionary on the first records it sees, up to `SAMPLE_BYTES`, and names files so that no two
attempts meet; only files in the written manifest count, so a lost or repeated task leaves
nothing that is read. A reader task streams an archive, one record in memory at a time.

Records of equal payloads of at least `revisit_from` bytes: the one with the largest page id is the
response, the others are revisits that refer to it.

Defined results
    null payload            empty payload
    null page id            written as such; smaller than any other id; if all ids of a group are
                            null, all its records are responses
    repeated page ids       every record that carries the group's largest id is a response
    null or odd url         no target or a percent-encoded one
    empty table             no archives, no records
    other columns           not read
    damaged archive         the read fails and names archive and record, or with strict=False
                            gives a row with `problem`, after which that archive is left
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from windspan.session import new_table_dir, written

# Fixed values of the WARC and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 1 << 15
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, archive string, problem string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


# Writing


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_bytes(row: dict) -> bytes:
    """A response or, if `row` has no payload, a revisit record."""
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % row["length"]
    )
    fields = [
        ("WARC-Type", "response" if row["payload"] is not None else "revisit"),
        ("WARC-Record-ID", _record_id(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + row["digest"]),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"]:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        fields.append(("WARC-Target-URI", safe))
    if row["payload"] is None:
        fields += [
            ("WARC-Refers-To", _record_id(row["refers_to"])),
            ("WARC-Profile", PROFILE),
        ]
    else:
        block += row["payload"]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None if the samples are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes records to archives below `folder`, each with its own leading dictionary."""

    def __init__(self, folder: str):
        self.fs, self.root = _opened(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder = folder
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.out = None
        self.done: list[dict] = []

    def add(self, record: bytes) -> None:
        if self.out is not None:
            self._put(record)
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        trained = train(self.waiting)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.root}/{name}", compression=None)
        self.info = {"path": f"{self.folder}/{name}", "records": 0, "bytes": 0}
        if trained is not None:
            held = trained.as_bytes()
            self._raw(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
        for record in self.waiting:
            self._put(record)
        self.waiting, self.waiting_bytes = [], 0

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.info["bytes"] += len(data)

    def _put(self, record: bytes) -> None:
        self._raw(self.packer.compress(record))
        self.info["records"] += 1
        if self.info["bytes"] >= ARCHIVE_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.out = None
        self.done.append(self.info)

    def close(self) -> list[dict]:
        if self.waiting:
            self._start()
        if self.out is not None:
            self._end()
        return self.done


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_from: int = 0,
) -> DataFrame:
    """Write a record per row to archives below `folder`; their manifest (path, records, bytes)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "length": F.octet_length("payload")})
    alike = (
        rows.filter(F.col("length") >= revisit_from)
        .groupBy("sha", "length")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("sha").alias("s"), F.col("length").alias("l"), "largest")
        .withColumn("shared", F.lit(True))
    )
    decided = rows.join(
        alike, (F.col("sha") == F.col("s")) & (F.col("length") == F.col("l")), "left"
    )
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    decided = decided.select(
        "page_id",
        "url",
        "sha",
        F.col("length").cast("long").alias("length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for row in batch.to_pylist():
                row["digest"] = base64.b32encode(row.pop("sha")).decode()
                writer = writer or ArchiveWriter(folder)
                writer.add(record_bytes(row))
        if writer is not None:
            made = writer.close()
            yield pa.RecordBatch.from_pylist(
                made,
                pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
            )

    return written(decided.mapInArrow(archive, MANIFEST), "warc-manifest")


# Reading


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _load_dictionary(held: bytes) -> zstandard.ZstdCompressionDict:
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return zstandard.ZstdCompressionDict(held)


def frames(read) -> Iterator[bytes]:
    """The content of each frame of an archive; `read(n)` gives its next bytes, b"" at the end.

    The dictionary is taken from a leading skippable frame; other skippable frames are passed.
    """
    pending, first, unpacker = b"", True, zstandard.ZstdDecompressor()

    def fill(least: int) -> bool:
        nonlocal pending
        parts, have = [pending], len(pending)
        while have < least and (more := read(max(READ_BYTES, least - have))):
            parts.append(more)
            have += len(more)
        pending = b"".join(parts)
        return have >= least

    while fill(1):
        if not fill(8):
            raise ArchiveError("cut off within a frame header")
        magic, size = struct.unpack("<II", pending[:8])
        if magic in SKIPPABLE:
            if not fill(8 + size):
                raise ArchiveError("cut off within a skippable frame")
            if first and magic == DICTIONARY_MAGIC:
                held = _load_dictionary(pending[8 : 8 + size])
                unpacker = zstandard.ZstdDecompressor(dict_data=held)
            pending = pending[8 + size :]
        elif magic == FRAME_MAGIC:
            one, parts = unpacker.decompressobj(), []
            while True:
                try:
                    parts.append(one.decompress(pending))
                except zstandard.ZstdError as broken:
                    raise ArchiveError(f"frame cannot be decoded: {broken}") from broken
                if one.eof:
                    break
                if not (pending := read(READ_BYTES)):
                    raise ArchiveError("cut off within a record")
            pending = one.unused_data
            yield b"".join(parts)
        else:
            raise ArchiveError(f"no frame starts with {magic:#x}")
        first = False


def _fields(head: bytes, what: str) -> dict[str, str]:
    made = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad {what} line {line[:80]!r}")
        made[name.decode("utf-8", "replace").strip().lower()] = value.decode(
            "utf-8", "replace"
        ).strip()
    return made


def _number(value: str | None, what: str) -> int:
    if value is None or not re.fullmatch(r"[0-9]+", value):
        raise ArchiveError(f"bad {what}: {value}")
    return int(value)


def _page_id(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?[0-9]+)>", record_id)
    if not found:
        raise ArchiveError(f"bad record id {record_id}")
    return None if found[1] == "null" else int(found[1])


def parse_record(data: bytes) -> dict:
    """The record in `data`, its headers, lengths and digest checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version != VERSION:
        raise ArchiveError(f"no {VERSION.decode()} header")
    fields = _fields(lines, "record header")
    if lacking := [k for k in REQUIRED if not fields.get(k)]:
        raise ArchiveError(f"header lacks {', '.join(lacking)}")
    length = _number(fields["content-length"], "content length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"content length {length}, but the block has {len(rest) - 4} bytes")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ArchiveError("block is no HTTP response")
    size = _number(_fields(lines, "HTTP header").get("content-length"), "payload length")
    digest = fields.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
        raise ArchiveError(f"bad payload digest {digest}")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise ArchiveError(f"payload length {size}, but there are {len(payload)} bytes")
        if "sha1:" + base32_sha1(payload) != digest:
            raise ArchiveError("payload does not match its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ArchiveError(f"bad {kind} record")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest.removeprefix("sha1:"),
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def archive_records(path: str, strict: bool = True) -> Iterator[dict]:
    fs, inner = _opened(path)
    n = 0
    with fs.open_input_stream(inner, compression=None) as source:
        try:
            for data in frames(source.read):
                yield parse_record(data) | {"archive": path, "problem": None}
                n += 1
        except ArchiveError as broken:
            if strict:
                raise ArchiveError(f"{path}, record {n}: {broken}") from broken
            yield {"archive": path, "problem": f"record {n}: {broken}"}


def read_archives(
    archives: DataFrame, payloads: bool = True, strict: bool = True, tasks: int | None = None
) -> DataFrame:
    """A row per record of the archives at `path`; without `payloads` that column is null."""
    spark = archives.sparkSession
    paths = archives.select("path").repartition(
        tasks or max(1, spark.sparkContext.defaultParallelism * 4)
    )
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in archive_records(path, strict):
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.mapInArrow(records, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder and read their records back."""
    made = write_archives(pages, new_table_dir(spark, "warc"), revisit_from=revisit_from)
    return read_archives(made, payloads=False)
