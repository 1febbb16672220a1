"""Probe documents in WARC archives: written as bounded records, read back as a chunked record table.

A probe's payload becomes one ``response`` record, or, beyond ``SEGMENT`` bytes, a
``response`` and ``continuation`` records of one segment each. A payload that an
earlier source has already stored becomes a ``revisit`` record without a block.
Spark's text writer puts the records into gzip files (the separator that follows
every WARC record is the line separator), so the files appear in any store that
Spark writes, once per committed task.

Reading streams each file through the decompressor. Rows of (record, chunk number)
come out as the bytes arrive, each with the digest of the payload up to its end,
carried over chunks and segments; no record is ever held as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.session import scratch_path, spill

#: Payload bytes of one record, and of one row of the chunk table.
SEGMENT = 1 << 20
CHUNK = 256 << 10
DATE = "2000-01-01T00:00:00Z"
_BREAK = b"\r\n\r\n"
_PIECE = 64 << 10
_ID = "urn:ratelens:source:{}:{}"
CHUNKS = (
    "record_id string, source_id long, target_uri string, record_type string, refers_to long, payload_digest string, "
    "segment int, chunk_no int, offset long, size int, running_digest string, last boolean, content binary"
)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.0", *(f"{name}: {value}" for name, value in fields if value is not None)]
    return "\r\n".join(lines).encode() + _BREAK


def _cuts(payload: memoryview) -> list[tuple[int, int]]:
    """Segments of a payload; in UTF-8 text none splits a character."""
    cuts, at = [], 0
    while len(payload) - at > SEGMENT:
        end = at + SEGMENT
        back = next((k for k in range(4) if payload[end - k] & 0xC0 != 0x80), 0)
        cuts.append((at, end - back))
        at = end - back
    return [*cuts, (at, len(payload))]


def _records(batches):
    """Rows (source_id, path, payload, refers_to) -> one row per WARC record, without its closing separator."""
    for batch in batches:
        columns = (batch.column(c) for c in ("source_id", "path", "payload", "refers_to"))
        for source, path, payload, refers in zip(*columns):
            source, refers, path = source.as_py(), refers.as_py(), path.as_py()
            payload = memoryview(payload.as_buffer() or b"") if payload.is_valid else memoryview(b"")
            digest = _base32(hashlib.sha1(payload).digest())
            name = _ID.format(source, digest)
            uri = None if path is None else urllib.parse.quote(path, safe="%/:?#[]@!$&'()*+,;=~-._")
            about = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
            if refers is not None:
                fields = [
                    ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *about,
                    ("WARC-Refers-To", f"<{_ID.format(refers, digest)}>"),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                    ("Content-Length", 0),
                ]
                yield _header(fields)
                continue
            cuts = _cuts(payload)
            for k, (begin, end) in enumerate(cuts):
                block = payload[begin:end]
                fields = [
                    ("WARC-Type", "continuation" if k else "response"),
                    ("WARC-Record-ID", f"<{name}:{k + 1}>" if k else f"<{name}>"), *about,
                    ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
                    ("WARC-Segment-Origin-ID", f"<{name}>" if k else None),
                    ("WARC-Segment-Number", k + 1 if len(cuts) > 1 else None),
                    ("WARC-Segment-Total-Length", len(payload) if k and k == len(cuts) - 1 else None),
                    ("Content-Length", end - begin),
                ]
                yield b"".join([_header(fields), block])


def _written(batches):
    held, size = [], 0
    for record in _records(batches):
        held.append(record)
        size += len(record)
        if size >= 4 * SEGMENT:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])


def write_archives(
    probes: DataFrame, folder: str, source: str = "source_id", path: str = "path", probe: str = "probe",
    least_bytes: int = 0,
) -> None:
    """Write a WARC record per row of ``probes`` into gzip files below the new ``folder``.

    The payload is the probe's UTF-8 text, or its bytes; null is empty. Among
    equal payloads (same length and SHA-1) of ``least_bytes`` or more, that of the
    smallest source is a response and the others revisit it; smaller payloads are
    all responses. Rows with a null source are not written; rows that repeat
    source and payload are one record when read. Other columns are not read. An
    empty table gives a folder without records.
    """
    rows = probes.where(F.col(source).isNotNull()).select(
        F.col(source).cast("long").alias("source_id"), F.col(path).cast("string").alias("path"),
        F.coalesce(F.col(probe).cast("binary"), F.lit(b"")).alias("payload"),
    )
    facts = spill(rows.select("source_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes")), "facts")
    copies = (
        facts.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes")
        .agg(F.min("source_id").alias("first"), F.max("source_id").alias("other")).where("first < other")
    )
    # Written out, so its size is known and Spark broadcasts it only if it is small.
    revisits = spill(
        facts.join(copies.drop("other"), ["sha1", "bytes"]).where("source_id > first")
        .select("source_id", F.col("sha1").alias("of"), F.col("first").alias("refers_to")).distinct(),
        "revisits",
    )
    match = (F.col("source_id") == F.col("s")) & (F.col("of") == F.sha1("payload"))
    (
        rows.join(revisits.withColumnRenamed("source_id", "s"), match, "left")
        .select("source_id", "path", "payload", "refers_to")
        .mapInArrow(_written, "record binary")
        .select(F.col("record").cast("string"))
        .write.option("lineSep", _BREAK.decode()).option("compression", "gzip").text(folder)
    )


def _pieces(data: memoryview):
    """Decompressed bytes of one or more gzip members, a bounded part at a time."""
    at, engine = 0, zlib.decompressobj(31)
    while at < len(data):
        part = bytes(data[at : at + _PIECE])
        at += len(part)
        while part:
            out = engine.decompress(part, 4 * _PIECE)
            if out:
                yield out
            if engine.eof:
                part, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                part = engine.unconsumed_tail


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ([^\r\n]*)")
_PARTS = re.compile(r"urn:ratelens:source:(-?\d+):")


class _Reader:
    """Takes the bytes of an archive as they come and gives rows of the chunk table."""

    def __init__(self, with_content: bool):
        self.buffer, self.left, self.with_content = bytearray(), 0, with_content
        self.row: dict = {}
        self.digests: dict = {}

    def feed(self, data: bytes):
        self.buffer += data
        while True:
            if self.row:
                yield from self._block()
                if self.row:
                    return
            # Between records: the separator that ended the last one, then a header.
            while self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            end = self.buffer.find(_BREAK)
            if end < 0:
                return
            self._open(bytes(self.buffer[:end]))
            del self.buffer[: end + len(_BREAK)]

    def _open(self, header: bytes) -> None:
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(header)}
        own = fields["warc-record-id"].strip("<>")
        origin = fields.get("warc-segment-origin-id", own).strip("<>")
        refers = _PARTS.match(fields.get("warc-refers-to", "").strip("<>"))
        segment = int(fields.get("warc-segment-number", 1))
        if segment == 1:
            state = (1, 0, 0, hashlib.sha1())
        else:  # goes on where the segment before ended, if that was read last
            state = self.digests.pop(origin, None)
            state = state if state and state[0] == segment else (segment, 0, None, None)
        self.digests.clear()
        self.chunk, self.offset, self.hash = state[1], state[2], state[3]
        self.left = int(fields["content-length"])
        whole = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
        self.row = {
            "record_id": origin, "source_id": int(_PARTS.match(origin)[1]), "target_uri": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"], "refers_to": int(refers[1]) if refers else None,
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "segment": segment, "whole": whole,
        }

    def _block(self):
        while True:
            size = min(self.left, CHUNK)
            if len(self.buffer) < size:
                return
            content = bytes(self.buffer[:size])
            del self.buffer[:size]
            self.left -= size
            if self.hash:
                self.hash.update(content)
            done = not self.left
            yield {
                **{k: v for k, v in self.row.items() if k != "whole"}, "chunk_no": self.chunk, "offset": self.offset,
                "size": size, "running_digest": _base32(self.hash.digest()) if self.hash else None,
                "last": done and self.row["whole"], "content": content if self.with_content else None,
            }
            self.chunk += 1
            self.offset = None if self.offset is None else self.offset + size
            if done:
                self.digests[self.row["record_id"]] = (self.row["segment"] + 1, self.chunk, self.offset, self.hash)
                self.row = {}
                return


def _chunk_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in CHUNKS.split(", ")])


def _chunks(with_content: bool):
    schema = _chunk_schema()

    def over(batches):
        for batch in batches:
            for file in batch.column("content"):
                reader, held, size = _Reader(with_content), [], 0
                for piece in _pieces(memoryview(file.as_buffer())):
                    for row in reader.feed(piece):
                        held.append(row)
                        size += row["size"] if with_content else 64
                        if size >= 4 * SEGMENT:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return over


def read_archives(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """The chunk table of the archives in ``folder``: columns ``CHUNKS``.

    One row per ``CHUNK`` payload bytes of a record, in order of ``segment`` and
    ``chunk_no``; an empty payload has one row of size 0. ``running_digest`` is the
    SHA-1 (base32) of the payload up to the chunk's end, null where a segment did
    not follow its predecessor in the file. ``content`` is null unless asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(_chunks(with_content), CHUNKS)


def archived_probes(chunks: DataFrame) -> DataFrame:
    """(source_id, record_id, payload_bytes, payload_digest, record_type, refers_to): one row per archived record.

    Size and digest of a response come from its chunks as read; those of a revisit
    from the response that it refers to.
    """
    pieces = chunks.dropDuplicates(["record_id", "segment", "chunk_no"])
    records = pieces.groupBy("record_id", "source_id").agg(
        F.sum("size").alias("payload_bytes"),
        F.max_by("running_digest", F.struct("segment", "chunk_no")).alias("payload_digest"),
        F.max("payload_digest").alias("stated"),
        F.max("refers_to").alias("refers_to"),
    )
    records = spill(records, "archive-records")
    first = records.where("refers_to IS NULL").select(
        F.col("source_id").alias("refers_to"), F.col("payload_digest").alias("stated"),
        F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"),
    )
    own = records.where("refers_to IS NULL").select(
        "source_id", "record_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), "refers_to"
    )
    again = records.where("refers_to IS NOT NULL").join(first, ["refers_to", "stated"], "left").select(
        "source_id", "record_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to",
    )
    return own.unionByName(again)


def archive_round_trip(
    probes: DataFrame, source: str = "source_id", path: str = "path", probe: str = "probe", least_bytes: int = 0
) -> DataFrame:
    """:func:`write_archives` into a new shared folder, then :func:`archived_probes` of what was read back."""
    spark = probes.sparkSession
    folder = scratch_path(spark, "archives")
    write_archives(probes, folder, source, path, probe, least_bytes)
    return archived_probes(read_archives(spark, folder))
