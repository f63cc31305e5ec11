"""WARC archives with a Zstandard dictionary in a leading skippable frame.

The dictionary is trained on records drawn by hash from all pages, ``dictionary_sample``
bytes at most. Every task writes archives of its own rows: the dictionary first, as the
skippable frame that readers of .warc.zst expect, then each record as a frame of its own. Records whose payload an earlier record holds are written as revisits. Files carry a
name of their own attempt, and only those that the written manifest lists count, so lost
or repeated tasks leave the result as it is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, stash, workspace

#: Fixed values of the formats: the skippable frame that holds a dictionary, the Zstandard frame, record types.
DICTIONARY_FRAME, ZSTD_FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
RESPONSE, REVISIT = "response", "revisit"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_ID = "<urn:page:{}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP head only. The page's number and size are extension fields."""
    kind = RESPONSE if refers_to is None else REVISIT
    block = HTTP_HEAD + payload if refers_to is None else HTTP_HEAD
    fields = [("WARC-Type", kind), ("WARC-Record-ID", RECORD_ID.format(uuid.uuid4() if page_id is None else page_id)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Refers-To", RECORD_ID.format(refers_to)), ("WARC-Profile", IDENTICAL)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload) of a record; the payload of a revisit is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, block.partition(b"\r\n\r\n")[2]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from whole records; where there are too few to train one, the raw end of them serves, and none without records."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ArchiveWriter:
    """Writes records to one archive, the dictionary first."""

    def __init__(self, out, dictionary: bytes, level: int):
        self.out = out
        self.bytes = 8 + len(dictionary)
        out.write(DICTIONARY_FRAME + struct.pack("<I", len(dictionary)) + dictionary)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=given, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.bytes += len(frame)
        self.out.write(frame)


def read_archive(stream, read: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, one frame in memory at a time."""
    head = stream.read(8)
    if head[:4] != DICTIONARY_FRAME:
        raise ValueError("an archive must start with its dictionary")
    dictionary = stream.read(struct.unpack("<I", head[4:])[0])
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=given)
    rest, done = b"", False
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not rest and not done:
                rest = stream.read(read)
                done = not rest
            if not rest:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts))


def page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to): payloads equal to that of a page with a smaller id refer to the smallest."""
    rows = page_rows(pages, id_col, url_col, html_col).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    known = rows.join(first, "sha", "left")
    return known.select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file; Hadoop's names of object stores are known too."""
    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        if uri.startswith(hadoop):
            uri = plain + uri.removeprefix(hadoop)
    return fs.FileSystem.from_uri(uri)


def sample_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str, records: int, size: int) -> list[bytes]:
    """Records drawn by hash from all pages, with a bound in number and bytes; equal rows are drawn once."""
    rows = page_rows(pages, id_col, url_col, html_col).withColumn("h", F.xxhash64("page_id", "payload"))
    first = rows.select("h", F.length("payload").alias("n")).where(F.col("n") <= size // 8).orderBy("h").limit(records).collect()
    most, total = None, 0
    for r in first:
        total += r["n"]
        if total > size:
            break
        most = r["h"]
    if most is None:
        return []
    drawn = rows.where((F.col("h") <= most) & (F.length("payload") <= size // 8)).dropDuplicates(["h"]).collect()
    drawn = sorted((r["h"], r["page_id"], r["url"], bytes(r["payload"])) for r in drawn)
    return [record_bytes(page_id, url, payload, payload_digest(payload), None, date) for _, page_id, url, payload in drawn]


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
    dictionary_size: int = 64 << 10,
    dictionary_sample: int = 8 << 20,
    dictionary_records: int = 2000,
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Write one record a row to archives in ``folder``; returns (path, records, bytes) of each, lazily: write it once.

    Null payloads count as empty. Of equal payloads of ``least_bytes`` or more the one with
    the smallest id is a response and those with larger ids are revisits; repeated rows of
    that id are responses too. A null id is always a response. The dictionary is trained on
    at most ``dictionary_records`` records of ``dictionary_sample`` bytes together, those
    with the smallest hashes of id and payload; it changes sizes of archives only.
    """

    rows = mark_revisits(pages, id_col, url_col, html_col, least_bytes)
    dictionary = train_dictionary(sample_records(pages, id_col, url_col, html_col, date, dictionary_records, dictionary_sample), dictionary_size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        count, out, writer = 0, None, None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal out, writer, count
            out.close()
            done[-1] = (done[-1][0], count, writer.bytes)
            out, writer, count = None, None, 0

        for part in (p for b in batches for p in bounded_slices(b, 2)):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    done.append((f"{folder}/{name}", 0, 0))
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = ArchiveWriter(out, dictionary, level)
                writer.add(record_bytes(page_id, url, payload, payload_digest(payload), refers_to, date))
                count += 1
                if writer.bytes >= archive_bytes:
                    finish()
        if writer is not None:
            finish()
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archives(spark: SparkSession, manifest: DataFrame, batch_rows: int = 1000, batch_bytes: int = 16 << 20) -> DataFrame:
    """Records of the archives that a manifest lists: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_folder(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for f, payload in read_archive(stream):
                        page, first = f.get("x-page-id"), f.get("warc-refers-to")
                        refers_to = int(first.rsplit(":", 1)[1].rstrip(">")) if first else None
                        digest, n = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-bytes"])
                        if f["warc-type"] == RESPONSE and (payload_digest(payload) != digest or len(payload) != n):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((int(page) if page is not None else None, f.get("warc-target-uri"), f["warc-type"], n, digest, refers_to, payload if f["warc-type"] == RESPONSE else None))
                        size += len(payload)
                        if len(rows) >= batch_rows or size >= batch_bytes:
                            yield packed()
                            rows, size = [], 0
        if rows:
            yield packed()

    files = manifest.select("path").repartition(max(1, min(10_000, manifest.count())), F.xxhash64("path"))
    return files.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: the read rows, payloads included."""
    spark = pages.sparkSession
    space = workspace(spark)
    manifest = stash(write_archives(pages, f"{space}/archives", **options), space, "manifest")
    return read_archives(spark, manifest)
