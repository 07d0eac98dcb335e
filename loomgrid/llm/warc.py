"""WARC archives in Zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; then comes one frame per
record, so that any record can be decoded alone. The writer trains the dictionary on a bounded
sample of payloads and packs a task's records into archives of bounded size, which a Spark table
of (archive, content) holds; ``read_archive_files`` reads real files in the same format. The
reader decodes frame by frame and checks headers, lengths and digests; what is wrong with a
record is told in its ``problem`` column and doesn't stop the others.

Payloads that are equal and not small are stored once: the record with the largest page_id is the
response, the others are revisits that refer to it. Which those are is found on digests alone,
summed up before they are shuffled.

Cases: a null payload is stored as an empty one, a null page_id as ``null`` (such a page never stands
for others); repeated rows are records of their own, all responses if theirs is the largest id;
ties in the largest page_id are all responses; an empty table gives no archives and an empty result; a very long payload gets an
archive of its own; page ids are whole numbers; other columns play no part, whatever their names. ``read_archive_files`` takes a whole file as one row, so archives
from elsewhere may have 2 GB at most (those written here have ARCHIVE_BYTES, or one payload, before compression).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# Fixed values of the formats.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Payloads below this size are never revisits; bytes of records in one archive; sample for the dictionary, and its size.
LEAST_REVISIT, ARCHIVE_BYTES, SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 1000, 8 << 20, 400, 8192, 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; where they are too few to train on, the samples themselves."""
    samples = [s for s in samples if s]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary


def make_record(page_id: int | None, url: str | None, kind: str, size: int, digest: str, refers_to: int | None, payload: bytes | None) -> bytes:
    """One record: its headers, an HTTP head, and the payload (none for a revisit)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    uri = "".join(c for c in (url or "") if c > " ")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and block headers."""
    p = at + 4
    flags = data[p]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    p += 1 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if p + 3 > len(data):
            raise ValueError("frame is cut off")
        h = int.from_bytes(data[p : p + 3], "little")
        last, kind, size = h & 1, h >> 1 & 3, h >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        p += 3 + (1 if kind == 1 else size)
    p += 4 * checksum
    if p > len(data):
        raise ValueError("frame is cut off")
    return p


def read_frames(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The records of an archive, one per frame, as (bytes, problem); the leading skippable frame gives the dictionary."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            yield None, "trailing bytes"
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                yield None, "skippable frame is cut off"
                return
            if at == 0 and magic == DICTIONARY:
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=_dict(raw)) if raw else reader
            at += 8 + size
            continue
        if magic != FRAME:
            yield None, "not a frame"
            return
        try:
            end = frame_end(data, at)
        except (ValueError, IndexError) as e:
            yield None, str(e) or "frame is cut off"
            return
        try:
            yield reader.decompressobj().decompress(bytes(data[at:end])), None
        except zstandard.ZstdError as e:
            yield None, f"frame can't be decoded: {e}"
        at = end


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers, payload and what is wrong (or None)."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not sep or not lines[0].startswith("WARC/"):
        return fields, b"", "no WARC header"
    if missing := [k for k in REQUIRED if k not in fields]:
        return fields, b"", f"missing {missing[0]}"
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return fields, b"", "length differs from Content-Length"
    payload = rest[:-4].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if digest and digest != hashlib.sha1(payload).hexdigest():
            return fields, payload, "payload differs from its digest"
        if fields.get("X-Payload-Length", str(len(payload))) != str(len(payload)):
            return fields, payload, "payload differs from its length"
    elif fields["WARC-Type"] == "revisit" and not fields.get("WARC-Refers-To"):
        return fields, payload, "a revisit that refers to nothing"
    return fields, payload, None


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, size, digest and, of revisits, the response's id."""
    slim = pages.select("page_id", F.octet_length("html").alias("size"), F.sha1("html").alias("digest")).filter((F.col("size") >= least) & F.col("page_id").isNotNull())
    same = slim.groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).filter("first <> least")
    revisits = slim.join(same, "digest").filter("page_id <> first").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("first").alias("refers_to"))
    revisits = staged(revisits, "revisits")
    base = pages.select("page_id", "url", "html", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    return base.join(revisits, (base["page_id"] == revisits["_id"]) & (base["digest"] == revisits["_digest"]), "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")


def dictionary_sample(pages: DataFrame) -> list[bytes]:
    """At most SAMPLE_PAGES different beginnings of pages, the same in every run.

    They are chosen by a digest with a threshold from the number of rows, so that about twice as many come together
    however many partitions and copies there are (fewer where pages are mostly null or equal).
    """
    place = F.pmod(F.xxhash64("s"), F.lit(1 << 40))
    threshold = min(1.0, 2 * SAMPLE_PAGES / max(pages.count(), 1)) * (1 << 40)
    pieces = pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("s")).filter((F.col("s") != "") & (place < threshold)).distinct()
    return [r["s"].encode() for r in pieces.orderBy(place, "s").limit(SAMPLE_PAGES).collect()]


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives of all pages as a staged table (archive, content); each content is a whole .warc.zst file."""
    dictionary = train_dictionary(dictionary_sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dictionary), write_content_size=True)
        task = TaskContext.get()
        frames, raw, n = [dictionary_frame(dictionary)], 0, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task.partitionId() if task else 0:06d}-{n:06d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            ids, urls, html, size, digest, refers = (batch.column(c) for c in ("page_id", "url", "html", "size", "digest", "refers_to"))
            for k in range(batch.num_rows):
                to = refers[k].as_py()
                payload = None if to is not None else (html[k].as_py() or "").encode()
                record = make_record(ids[k].as_py(), urls[k].as_py(), "response" if to is None else "revisit", size[k].as_py(), digest[k].as_py(), to, payload)
                frames.append(packer.compress(record))
                raw += len(record)
                if raw >= archive_bytes:
                    yield done()
                    frames, raw, n = [dictionary_frame(dictionary)], 0, n + 1
        if len(frames) > 1:
            yield done()

    return staged(planned(pages, least).mapInArrow(run, "archive string, content binary"), "archives")


RECORDS = "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, problem string"


def _page(uri: str | None) -> int | None:
    x = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def _reader(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RECORDS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for record, problem in read_frames(content.as_py()):
                    fields, payload, wrong = parse_record(record) if record is not None else ({}, b"", problem)
                    size = fields.get("X-Payload-Length", "")
                    kind = fields.get("WARC-Type")
                    text = payload.decode("utf-8", "replace") if with_text and kind == "response" else None
                    measured = len(payload) if kind == "response" else int(size) if size.isdigit() else None
                    rows.append((name, _page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), measured, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, kind, _page(fields.get("WARC-Refers-To")), text, wrong))
                    held += len(text or "")
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(archives: DataFrame, with_text: bool = True) -> DataFrame:
    """The records of a table of (archive, content)."""
    return archives.select("archive", "content").mapInArrow(_reader(with_text), RECORDS)


def read_archive_files(spark: object, path: str, with_text: bool = True) -> DataFrame:
    """The records of .warc.zst files under a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), "content"), with_text)
