"""Web archives with one dictionary each, written and read a record at a time."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import random
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import frames

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: An archive is closed at so many bytes of records; a task holds no more than that at once, or
#: one record.
ARCHIVE_BYTES = 32 * 1024 * 1024
#: The dictionary of an archive is built from its records: from so many bytes of them, spread evenly.
SAMPLE_BYTES = 4 * 1024 * 1024
DICTIONARY_BYTES = 64 * 1024
#: What a record gives to the sample at most, and the pieces of a longer one.
RECORD_BYTES = 64 * 1024
PIECE_BYTES = 4 * 1024
LEVEL = 3
#: Fixed value: the profile of records whose payload stands elsewhere.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "archive string, records bigint, bytes bigint, dictionary_bytes bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, archive string, at bigint, payload binary"
)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(marker: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(marker))}>"


def record(page: dict) -> bytes:
    """The bytes of one record: a whole response, or for a revisit its HTTP head alone."""
    payload, revisit = page["payload"], page["first_marker"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page["marker"])),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"),
    ]
    if page["url"] is not None:
        fields.append(("WARC-Target-URI", quote(page["url"], safe="%/:=&?~#+!$,;'@()*[]")))
    if page["page_id"] is not None:
        fields.append(("Page-ID", str(page["page_id"])))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(page["first_marker"]))]
        if page["first_id"] is not None:
            fields.append(("Refers-To-Page-ID", str(page["first_id"])))
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def sampled(one: bytes) -> bytes:
    """A record, or of a long one RECORD_BYTES in pieces spread evenly from its first byte to its last."""
    if len(one) <= RECORD_BYTES:
        return one
    pieces = RECORD_BYTES // PIECE_BYTES
    starts = (k * (len(one) - PIECE_BYTES) // (pieces - 1) for k in range(pieces))
    return b"".join(one[at : at + PIECE_BYTES] for at in starts)


def packed_bytes(records: list[bytes], own: zstandard.ZstdCompressionDict | None) -> int:
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
    return sum(len(packer.compress(one)) for one in records)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records of an archive.

    Where they are too few or too short to train one, it is plain content of about one record's
    size, taken from their starts, or none if that would make the archive larger.
    """
    total = sum(map(len, records))
    some = records
    if total > SAMPLE_BYTES:
        some = random.Random(len(records)).sample(records, max(1, len(records) * SAMPLE_BYTES // total))
    samples = [sampled(r) for r in some]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, f=18, accel=4, level=LEVEL)
    except zstandard.ZstdError:
        content = b"".join(samples)[: min(DICTIONARY_BYTES, total // len(records))]
        plain = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return plain if packed_bytes(records, plain) + len(content) < packed_bytes(records, None) else None


def write_archive(path: str, records: list[bytes]) -> int:
    """One archive, under its name only once it is complete; the size of its dictionary."""
    store, place = filesystem(path)
    trained = dictionary(records)
    own = trained.as_bytes() if trained else b""
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    unfinished = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(unfinished, compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(own)) + own)
        for one in records:
            out.write(packer.compress(one))
    store.move(unfinished, place)
    return len(own)


def written(folder: str):
    """The writer of one task: archives named by the number of its partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        store.create_dir(place, recursive=True)
        task, numbers, held, size = TaskContext.get().partitionId(), itertools.count(), [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{task:07d}-{next(numbers):05d}.warc.zst"
            own = write_archive(path, held)
            return pa.RecordBatch.from_pylist(
                [{"archive": path, "records": len(held), "bytes": size, "dictionary_bytes": own}]
            )

        for batch in batches:
            for at in range(batch.num_rows):
                one = record(batch.slice(at, 1).to_pylist()[0])
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield close()

    return write


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Writes `pages` as archives in `folder`, a shared one; returns the list of archives.

    Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest id
    is a response and the others are revisits of it; shorter ones are all responses. A missing
    payload is an empty one. A missing id comes after all others; of equal ids the first row
    read comes first. Payloads are grouped by length and two digests before the texts move;
    the join with their groups is a plain one, which Spark splits where a payload is frequent.

    Each archive holds a skippable frame with its own dictionary, built from its records, then one
    Zstandard frame per record, so that records can be read from any offset. A task that runs
    again writes the same archives under the same names. An empty table gives no archives.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.length(payload).alias("n"),
        F.unhex(F.sha1(payload)).alias("sha1"), F.xxhash64(payload).alias("xx"),
    )
    rows = frames.staged(frames.numbered(rows), "warc-rows")
    keys = ["n", "sha1", "xx"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "marker")).alias("first")
    groups = (
        rows.filter(F.col("n") >= least_bytes)
        .groupBy(*keys)
        .agg(first, F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(*keys, "first")
    )
    again = F.col("first.marker") != F.col("marker")
    planned = rows.join(frames.staged(groups, "warc-groups"), keys, "left").select(
        "page_id", "url", "payload", "marker",
        F.when(again, F.col("first.marker")).alias("first_marker"),
        F.when(again, F.col("first.page_id")).alias("first_id"),
    )
    return frames.staged(planned.mapInArrow(written(folder), MANIFEST), "warc-manifest")


def parsed(raw: bytes) -> dict:
    """The fields and payload of one record; the digest of a response is computed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID") if revisit else None, "payload": None if revisit else payload,
    }


def records_of(path: str, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive, with one record in memory."""
    store, place = filesystem(path)
    with store.open_input_stream(place, compression=None) as file:
        magic, length = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} has no dictionary frame")
        own = file.read(length)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
        start, at, rest = 8 + length, 8 + length, b""
        frame, out = unpacker.decompressobj(), io.BytesIO()
        while rest or (rest := file.read(block)):
            out.write(frame.decompress(rest))
            left = frame.unused_data if frame.eof else b""
            at += len(rest) - len(left)
            rest = left
            if frame.eof:
                yield start, out.getvalue()
                start, frame, out = at, unpacker.decompressobj(), io.BytesIO()
        if at != start:
            raise ValueError(f"{path} ends within a record")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives listed in column `archive`.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, at (the
    record's offset) and payload (null for revisits, left out without `payloads`). Payloads of
    responses are checked against their digests; damage is an error. An archive is read by one
    task, a record at a time.
    """
    fields = [f for f in RECORDS.split(", ") if payloads or not f.startswith("payload binary")]
    schema = pa.schema([(f.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column(0)):
            rows, size = [], 0
            for at, raw in records_of(path):
                rows.append(parsed(raw) | {"archive": path, "at": at})
                size += len(raw) if payloads else 400
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    listed = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return listed.mapInArrow(read, ", ".join(fields))


def archive_folder(spark: SparkSession) -> str:
    return frames.new_path(spark, "warc")
