"""Archives: exact round trips, and files that other readers understand."""

import base64
import glob
import gzip
import hashlib

import pytest

from ratelens.llm import archives
from ratelens.llm.archives import archive_round_trip, archived_probes, read_archives, write_archives
from ratelens.session import scratch_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    """(source, payload) -> expected row."""
    first = {}
    for source, payload in rows:
        if len(payload) >= least:
            first[payload] = min(first.get(payload, source), source)
    return sorted(
        (s, len(p), digest(p), "response" if first.get(p, s) == s else "revisit", None if first.get(p, s) == s else first[p])
        for s, p in set(rows)
    )


def rows_of(df):
    return sorted((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


TEXTS = [
    (5, "b", "{}"), (2, "a", "{}"), (9, None, "{}"), (1, "x\r\ny z/ü", ""), (3, "c", None),
    (4, "d", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "e", "\r\n\r\n\r\n\r\n"), (7, "f", "é" * 5000), (7, "f", "é" * 5000),
    (8, "g", "x" * 4097 + "\r\n"), (7, "f", "other"),
]


@pytest.mark.parametrize("segment,chunk", [(1 << 20, 256 << 10), (1000, 300), (64, 7)])
def test_round_trip(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(archives, "SEGMENT", segment)
    monkeypatch.setattr(archives, "CHUNK", chunk)
    df = spark.createDataFrame(TEXTS, "source_id long, path string, probe string").coalesce(2)
    expected = [(s, (p or "").encode()) for s, _, p in TEXTS]
    assert rows_of(archive_round_trip(df)) == plain(expected)
    assert rows_of(archive_round_trip(df, least_bytes=3)) == plain(expected, 3)


def test_chunks_carry_the_digest_so_far_and_give_the_payload_back(spark, monkeypatch):
    folder = scratch_path(spark, "test")
    payload = bytes(range(256)) * 900 + b"\r\n\r\n"
    df = spark.createDataFrame([(1, "p", bytearray(payload))], "source_id long, path string, probe binary")
    # Tasks are other processes: sizes that matter there are set by their own modules.
    write_archives(df, folder)
    rows = sorted(read_archives(spark, folder, with_content=True).collect(), key=lambda r: (r.segment, r.chunk_no))
    so_far = b""
    for r in rows:
        assert r.offset == len(so_far) and r.size == len(r.content)
        so_far += r.content
        assert r.running_digest == digest(so_far)
    assert so_far == payload and rows[-1]["last"] and rows[-1].payload_digest == digest(payload)


def test_long_payload_in_segments(spark):
    text = "0123456789é" * 250_000
    df = spark.createDataFrame([(1, "p", text), (2, "q", text), (3, "r", text[:-1])], "source_id long, path string, probe string")
    folder = scratch_path(spark, "test")
    write_archives(df, folder)
    chunks = read_archives(spark, folder)
    assert chunks.where("source_id = 1").agg({"segment": "max"}).first()[0] == 3
    assert chunks.agg({"size": "max"}).first()[0] <= archives.CHUNK
    assert chunks.where("content IS NOT NULL").count() == 0
    expected = [(1, text.encode()), (2, text.encode()), (3, text[:-1].encode())]
    assert rows_of(archived_probes(chunks)) == plain(expected)


def test_files_are_gzipped_warc(spark):
    folder = scratch_path(spark, "test")
    write_archives(spark.createDataFrame(TEXTS, "source_id long, path string, probe string"), folder)
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(folder.removeprefix("file:") + "/*.gz"))
    at, count = 0, 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\nWARC-Type: ")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[length : length + 4] == b"\r\n\r\n"
        at += len(head) + 4 + length + 4
        count += 1
    assert count == len(TEXTS)


def test_reader_takes_bytes_in_any_portions():
    record = archives._header([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:ratelens:source:1:X>"), ("Content-Length", 5)])
    data = (record + b"ab\r\n\r\r\n\r\n") * 3
    for step in (1, 2, 7, len(data)):
        reader = archives._Reader(True)
        rows = [row for k in range(0, len(data), step) for row in reader.feed(data[k : k + step])]
        assert [r["content"] for r in rows] == [b"ab\r\n\r"] * 3


def test_odd_input(spark):
    odd = spark.createDataFrame([(None, "p", "text", 1)], "source_id long, path string, probe string, refers_to int")
    assert archive_round_trip(odd).count() == 0
    assert archive_round_trip(odd.where("false")).count() == 0
