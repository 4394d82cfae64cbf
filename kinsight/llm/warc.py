"""WARC archives of one Zstandard frame per record, with a shared dictionary.

An archive is a skippable frame that holds the dictionary, then a frame for
each record. Spark's text writer puts the frames into files, so archives can be
on any file system that Spark writes and come under its commit protocol; the
"line separator" is an empty skippable frame, which readers of Zstandard pass
over. The reader loads the dictionary from the leading frame, decodes frame by
frame, and validates headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Magic numbers of a Zstandard frame and of skippable frames; 0x184D2A5D marks the dictionary.
FRAME, SKIP, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
#: An empty skippable frame, which has only ASCII characters.
EMPTY_FRAME = struct.pack("<II", SKIP, 0)
#: Equal payloads of at least so many bytes become revisits of one of them.
REVISIT_BYTES = 1000
#: The dictionary is fitted on at most so many payloads, the first bytes of each; its size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 65536
#: A record may not be larger than this when read.
MOST = 1 << 31
LEVEL = 3
#: Bytes of an archive that the reader takes at a time.
STEP = 16384


def fit_dictionary(pages: DataFrame, key: str, payload: str) -> bytes:
    """A dictionary of a bounded sample: the SAMPLES rows whose key hashes lowest. With too few rows, their bytes in a row."""
    hashed = F.xxhash64(key)
    # the bound comes first, from hashes alone, so that a task sends the payloads of the sample only
    bound = pages.select(hashed.alias("h")).orderBy("h").limit(SAMPLES).agg(F.max("h")).first()[0]
    first = F.substring(F.coalesce(F.col(payload), F.lit("")), 1, SAMPLE_BYTES).cast("binary")
    rows = pages.select(first.alias("p"), hashed.alias("h")).where(F.col("h") <= F.lit(bound)).distinct().orderBy("h", "p").limit(SAMPLES)
    found = [bytes(r["p"]) for r in rows.select("p").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(found)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole WARC record; a revisit has no body."""
    body = b"" if kind == "revisit" else payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"X-Payload-Length: {len(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One archive for each partition. Of equal payloads of REVISIT_BYTES or more, the largest page_id (nulls lowest) is a response, the others revisits.

    Rows that repeat it, id and payload, are responses as well. A null payload
    is an empty one. Other columns are not read; no rows give archives without records.
    """
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    last = own.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    # only copies carry their digest's key into the join, the rest stay where they are
    kinds = (
        own.where(large)
        .select("page_id", "digest")
        .join(last, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("last")))
        .select("page_id", "digest", "last")
        .distinct()
    )
    kinds = kinds.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "last")
    rows = own.join(kinds, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    rows = rows.select("page_id", "url", "payload", F.col("again_digest").isNotNull().alias("again"), "last")
    dictionary = fit_dictionary(own, "page_id", "payload")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary], pa.binary())], ["frame"])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = [c.to_pylist() for c in part.columns]
                out = [packer.compress(record("revisit" if again else "response", k, u, p, last)) for k, u, p, again, last in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record. Raises ValueError where an archive is not whole or a record not valid."""
    at, reader = 0, zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"a frame is cut off at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIP:
            if at + 8 + size > len(view):
                raise ValueError(f"a skippable frame is cut off at byte {at}")
            if magic == DICTIONARY:
                if at:
                    raise ValueError("the dictionary is not the leading frame")
                raw = bytes(view[8 : 8 + size])
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame begins at byte {at}")
        one, parts = reader.decompressobj(), []
        while not one.eof:  # in steps, as what is left over is copied
            step = view[at : at + STEP]
            if not step:
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield parse(b"".join(parts))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and body; ValueError if its header or lengths are not valid."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header field: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise ValueError(f"header fields are missing: {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n" or size > MOST:
        raise ValueError("the content length does not hold")
    return fields, rest[:size]


READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in path; digests of bodies are verified."""

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for fields, body in records(batch.column(0)[k].as_buffer()):
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size = fields["warc-type"], int(fields["x-payload-length"])
                    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
                        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
                    url = fields.get("warc-target-uri")
                    url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((number(fields["warc-record-id"]), url, None if kind == "revisit" else body, size, digest, kind, number(fields.get("warc-refers-to"))))
                    if len(rows) == 500:
                        yield made(rows)
                        rows = []
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of pages written as archives and read back; write_archives says how odd rows are taken."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), last AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id IS DISTINCT FROM l.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id IS DISTINCT FROM l.last THEN l.last END AS refers_to
FROM p LEFT JOIN last l ON p.digest = l.digest AND p.n >= 1000
"""
