"""Dictionary-compressed WARC archives.

Each archive is one file that Spark's text sink writes, so any store that Spark writes to will do,
and a lost task is written again under Spark's commit protocol. A file is a sequence of
Zstandard frames:

* a skippable frame that holds the dictionary, trained on the first records of the archive,
* one frame for each WARC record, compressed by itself with that dictionary,
* after each of them a skippable frame with a payload of one byte. That byte is the line feed
  which the text sink puts behind every row, so the file is a valid Zstandard stream.

Records with equal payloads are stored once: the one with the smallest page_id is a response, the
others are revisits that refer to it.

Defined results: null html is an empty payload; a null url leaves the target out; a null page_id
counts as the smallest, so its record is the response, and revisits of it refer to no page; rows
that repeat a page_id and its payload are written each and have the same type; an empty table
gives no archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.util import bound_batches, materialize, scratch_dir

#: Payload bytes of one archive, about; archives get larger where there would be more than MOST_ARCHIVES.
ARCHIVE_BYTES, MOST_ARCHIVES = 16 << 20, 100_000
#: Rows of one file, its dictionary among them: many rows of one page fill several files.
FILE_ROWS = 20_000
#: The dictionary is trained on the first records of its archive, up to this many and this many bytes.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 32 << 10
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
LEVEL = 3

#: Fixed values of the formats.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32, from built-in functions: five bytes of it make eight characters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, revisit, refers_to) of each distinct page_id and payload."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    ids = materialize(pages.select("page_id", sha1_base32(body).alias("payload_digest"), F.octet_length(body).cast("bigint").alias("payload_bytes")).distinct())
    key = ["payload_digest", "payload_bytes"]
    first = materialize(ids.groupBy(*key).agg(F.min_by("page_id", F.struct(F.col("page_id").isNotNull(), "page_id")).alias("first_id")))
    again = (F.col("payload_bytes") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return ids.join(first, key).select("page_id", *key, again.alias("revisit"), F.when(again, F.col("first_id")).alias("refers_to"))


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, revisit: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload."""
    payload = (html or "").encode("utf-8")
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_line(url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block = http + payload
    else:
        block = http
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        if refers_to is not None:
            fields.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        fields.append(f"X-Page: {page_id}")
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record as it is stored.

    Size and digest of a response are taken from its payload, those of a revisit from its fields.
    """
    head, block = record.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda k: int(fields[k]) if k in fields else None
    out = {"page_id": number("X-Page"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "url": fields.get("WARC-Target-URI")}
    if out["record_type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"digest of page {out['page_id']} does not match its payload")
        return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out | {"payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; of too few samples to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def archive_rows(records: Iterable[bytes], file_rows: int = FILE_ROWS) -> Iterator[bytes]:
    """The frames of one archive; each is to be followed by a line feed.

    After every ``file_rows`` of them a new file starts, with the same dictionary.
    """
    tail = struct.pack("<II", SKIPPABLE_FIRST, 1)
    compress, held, size, rows, head = None, [], 0, 0, b""

    def framed(record: bytes) -> Iterator[bytes]:
        nonlocal rows
        if rows % file_rows == 0:
            rows += 1
            yield head
        rows += 1
        yield compress(record) + tail

    def start() -> Iterator[bytes]:
        nonlocal compress, head
        raw = train_dictionary(held)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
        head = struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw + tail
        for x in held:
            yield from framed(x)

    for record in records:
        if compress:
            yield from framed(record)
            continue
        held.append(record)
        size += len(record)
        if len(held) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
            yield from start()
            held.clear()
    if held:
        yield from start()


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends: its header and block headers say it."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last = head & 1
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    return at + 4 * (flags >> 2 & 1)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    data, at = memoryview(content), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == SKIPPABLE_DICTIONARY:
                decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic == ZSTD_MAGIC:
            end = _frame_end(data, at)
            yield decoder.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, file_rows: int = FILE_ROWS) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in the folder ``path``."""
    plan = materialize(plan_records(pages, least_revisit))
    total = plan.agg(F.sum("payload_bytes")).first()[0] or 0
    n = max(1, min(MOST_ARCHIVES, -(-total // archive_bytes)))
    body = F.coalesce("html", F.lit("")).cast("binary")
    key = F.xxhash64("page_id", "payload_digest")
    rows = pages.select("page_id", "url", "html").withColumn("payload_digest", sha1_base32(body)).withColumn("key", key)
    # both sides are dealt by one key into as many parts as there are archives: the join needs no other shuffle
    left, right = rows.repartition(n, "key").alias("r"), plan.withColumn("key", key).repartition(n, "key").alias("p")
    # written as ranges, the other two conditions do not become join keys, which would ask for a shuffle by all three
    same = [F.col("r.key") == F.col("p.key"), F.col("r.payload_digest").between(F.col("p.payload_digest"), F.col("p.payload_digest"))]
    same.append(F.coalesce("r.page_id", F.lit(-1)).between(F.coalesce("p.page_id", F.lit(-1)), F.coalesce("p.page_id", F.lit(-1))))
    joined = left.join(right, same).select("r.page_id", "url", "html", "p.payload_digest", "payload_bytes", "revisit", "refers_to")

    bound_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield build_record(*row)

        for frames in archive_rows(records(), file_rows):
            yield pa.RecordBatch.from_arrays([pa.array([frames], pa.binary())], names=["frames"])

    frames = joined.mapInArrow(run, "frames binary")
    # the writer's own options, whatever the session says: files of file_rows rows, not compressed once more
    frames.select(F.col("frames").cast("string")).write.option("maxRecordsPerFile", file_rows).option("compression", "none").text(path, lineSep="\n")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives in ``path``."""
    names = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    if payloads:
        names["payload"] = pa.binary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for record in read_archive(content.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) >= 2000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in names.items()], names=list(names))

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives to ``path`` (a new shared folder if None) and read them back."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
