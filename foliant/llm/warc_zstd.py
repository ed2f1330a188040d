"""WARC archives of Zstandard frames with a dictionary in the leading skippable frame.

An archive is a skippable frame with the dictionary, then a frame for each record. Spark writes and
reads the archives, so that they lie in any store and outlive lost executors: rows of frames go
through the text writer, whose line separator is an empty skippable frame, and come back through
the binaryFile reader.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch

#: Magic number of the frame that carries a dictionary, and of all skippable frames.
DICT_MAGIC, SKIPPABLE = 0x184D2A5D, 0x184D2A50
#: An empty skippable frame: all of its bytes are ASCII, so that it can be a line separator.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Smallest payload that is written once, records that a dictionary is trained from, and its size.
LEAST_SHARED, SAMPLES, DICT_BYTES = 1000, 200, 16 << 10
LEAST_STEP = 4 << 10
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload of its own, its headers tell the full one's."""
    block = payload if kind == "response" else b""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url).encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if kind == "revisit":
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"X-Payload-Length: %d" % len(payload), b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading frame and its dictionary; an empty frame if the samples are too few to train one."""
    try:
        made = zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples)
        raw = made.as_bytes()
    except (zstandard.ZstdError, ValueError):
        made, raw = None, b""
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw, made


def _frames(batches):
    """Rows (frame): the dictionary's, then one for each record; a partition is an archive."""
    packer = None
    for batch in batches:
        rows = batch.to_pylist()
        records = [record(r["page_id"], r["url"], r["kind"], r["payload"] or b"", r["digest"], r["refers_to"]) for r in rows]
        frames = []
        if packer is None and records:
            first, made = dictionary_frame([x for x in records[:SAMPLES] if x])
            packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True)
            frames.append(first)
        frames += [packer.compress(x) for x in records]
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])


def frames_of(archive: bytes):
    """(decompressor, frame) of each data frame of an archive, the dictionary taken from the leading frame."""
    view, at, unpacker, first = memoryview(archive), 0, None, True
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if len(magic) < 4:
            raise ValueError(f"{len(magic)} bytes are left over at the end")
        number = struct.unpack("<I", magic)[0]
        if number & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 > len(view):
                raise ValueError("a skippable frame is cut short")
            size = struct.unpack("<I", view[at + 4 : at + 8])[0]
            if at + 8 + size > len(view):
                raise ValueError("a skippable frame is cut short")
            if number == DICT_MAGIC:
                if not first:
                    raise ValueError("the dictionary isn't in the leading frame")
                raw = bytes(view[at + 8 : at + 8 + size])
                if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
            at, first = at + 8 + size, False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {at}")
        unpacker, first = unpacker or zstandard.ZstdDecompressor(), False
        one, parts, to, step = unpacker.decompressobj(), [], at, LEAST_STEP
        while not one.eof and to < len(view):  # in steps: what is handed over beyond a frame is copied back
            parts.append(one.decompress(view[to : to + step]))
            to, step = min(to + step, len(view)), 2 * step
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut short")
        at = to - len(one.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple:
    """A row of READ: headers, lengths and digest are checked, and problem tells what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(b":") for x in lines[1:]) if colon}
    number = lambda raw: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", raw or b"")) else None
    page, kind = number(fields.get(b"warc-record-id")), fields.get(b"warc-type", b"").decode("utf-8", "replace")
    digest, told = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace"), fields.get(b"x-payload-length", b"")
    length = fields.get(b"content-length", b"")
    problem = None
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        problem = "no WARC header"
    elif not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        problem = "the block isn't as long as its header says"
    elif kind not in ("response", "revisit"):
        problem = f"record of type {kind}"
    block = rest[:-4]
    if problem is None and kind == "response":
        if hashlib.sha1(block).hexdigest() != digest or told != str(len(block)).encode():
            problem = "the payload doesn't match its digest or length"
    elif problem is None and (block or not told.isdigit() or number(fields.get(b"warc-refers-to")) is None):
        problem = "a revisit needs a length, what it refers to, and no block"
    return page, int(told) if told.isdigit() else None, digest, kind, number(fields.get(b"warc-refers-to")), block, problem


def _records(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows, held = [], 0
            try:
                for data in frames_of(content):
                    rows.append(parse_record(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield give(rows)
                        rows, held = [], 0
            except (ValueError, zstandard.ZstdError) as broken:
                rows.append((None, None, None, None, None, None, str(broken)))
            if rows:
                yield give(rows)


def write_archives(spark: SparkSession, pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archives: int | None = None) -> None:
    """Writes a record for each row of pages. Of equal payloads of LEAST_SHARED bytes or more the row
    with the largest id is a response and the others revisit it; smaller ones are all responses. A
    null html is an empty payload; null ids come first, and rows that repeat the largest id are all
    responses. A partition becomes an archive."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "large": F.octet_length("payload") >= LEAST_SHARED})
    # small payloads get keys of their own: they match nothing and don't meet in one task
    rows = rows.withColumn("key", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    shared = rows.where("large").groupBy("key").agg(F.max("page_id").alias("main"), F.count(F.lit(1)).alias("copies"), F.count("page_id").alias("named"))
    # written first: a join of two plain shuffles is one that Spark splits where a payload is hot
    shared = Scratch(spark).save(shared.where("copies > 1 AND named > 0").select("key", "main"), "shared")
    told = rows.join(shared, "key", "left")
    main = F.col("page_id").eqNullSafe(F.col("main"))
    told = told.withColumn("kind", F.when(F.col("main").isNull() | main, "response").otherwise("revisit"))
    told = told.withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("main")))
    told = told.select("page_id", "url", "kind", "payload", "digest", "refers_to")
    if archives:
        told = told.repartition(archives)
    told.mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives at path (READ); problem is null where headers, lengths and digest hold."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_records, READ)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder and read back.

    An empty table gives no record. Rows that could not be read back whole raise when the result is
    used. Other columns of pages are left out."""
    path = f"{Scratch(spark).root}/warc"
    write_archives(spark, pages, path)
    back = read_archives(spark, path)
    sound = F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("archive: "), F.col("problem"))).cast("long"))
    return back.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS main FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> main THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> main THEN main END AS refers_to FROM m"""
