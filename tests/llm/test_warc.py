"""Archives: written, normalised, read again; and archives that others wrote."""

import gzip
import os
import zlib
from hashlib import sha256

import pytest

from plumbline.llm import warc

SCHEMA = "page_id bigint, url string, html string, id string, digest string, payload string, least int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def through(spark, rows, folder=None, **options):
    return warc.read(warc.normalise(warc.write(frame(spark, rows), folder and f"{folder}/whole", **options), folder and f"{folder}/members"))


PAGES = [(i, f"http://h{i % 3}.example/a b/é?q={i}", f"<p>page {i} é</p>" * (1 + i * 3)) for i in range(40)]
COPY = "<p>the same again and again, longer than a hundred bytes</p>" * 2


def test_round_trip(spark):
    rows = [*PAGES, (50, None, None), (51, "", ""), (None, None, "no id"), (60, "u", "\r\n\r\n  WARC/1.1\r\n\r\n"), (61, "u", "x" * 3_000_000)]
    got = sorted((r.page_id or "", r.payload.decode(), r.payload_bytes, r.payload_digest, r.type) for r in through(spark, rows).collect())
    want = sorted((str(i) if i is not None else "", h or "", len((h or "").encode()), sha256((h or "").encode()).hexdigest(), "response") for i, _, h in rows)
    assert got == want


def test_revisits(spark):
    rows = [(i, "u", COPY) for i in (9, 4, 7, 12)] + [(i, "u", "short") for i in (1, 2)] + [(3, "u", COPY + "!")] + [(None, "u", COPY)]
    got = {(r.page_id, r.type, r.refers_to_page, r.payload_bytes, r.payload_digest) for r in through(spark, rows).collect()}
    size, digest = len(COPY), sha256(COPY.encode()).hexdigest()
    revisits = {(p, "revisit", "4", size, digest) for p in ("9", "7", "12", None)}
    assert got >= revisits | {("4", "response", None, size, digest)}
    assert {(p, t) for p, t, *_ in got - revisits} == {("4", "response"), ("1", "response"), ("2", "response"), ("3", "response")}
    by_id = {r.page_id: r for r in through(spark, rows).collect()}
    assert by_id["9"].refers_to == by_id["4"].record_id


def test_rows_that_share_the_smallest_id_are_responses(spark):
    rows = [(1, "a", COPY), (1, "b", COPY), (2, "c", COPY)]
    got = sorted((r.page_id, r.type, r.refers_to_page or "") for r in through(spark, rows).collect())
    assert got == [("1", "response", ""), ("1", "response", ""), ("2", "revisit", "1")]
    nobody = [(None, "a", COPY), (None, "b", COPY)]
    assert [r.type for r in through(spark, nobody).collect()] == ["response"] * 2


def test_empty_table(spark):
    assert through(spark, []).collect() == []


def test_files(spark, tmp_path):
    """Whole archives are one stream; normalised ones open at each offset of the sidecar."""
    index = warc.normalise(warc.write(frame(spark, PAGES).coalesce(1), str(tmp_path / "whole"), archive_bytes=4000), str(tmp_path / "members")).collect()
    whole = [tmp_path / "whole" / f for f in os.listdir(tmp_path / "whole")]
    assert len(whole) > 3
    for f in whole:
        one = zlib.decompressobj(31)
        assert one.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") and one.eof and not one.unused_data
    assert len(index) == len(PAGES)
    lines = 0
    for f in os.listdir(tmp_path / "members"):
        if f.endswith(".idx"):
            raw = (tmp_path / "members" / f[:-4]).read_bytes()
            for line in (tmp_path / "members" / f).read_text().splitlines():
                offset, length, kind, record_id = line.split("\t")[:4]
                member = zlib.decompressobj(31)
                text = member.decompress(raw[int(offset):int(offset) + int(length)])
                assert member.eof and not member.unused_data and record_id.encode() in text and kind == "response"
                assert text.endswith(b"\r\n\r\n")
                lines += 1
            # the same records in the same order as one file
            assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type") == len((tmp_path / "members" / f).read_text().splitlines())
    assert lines == len(PAGES)


def foreign(*blocks, kind="response"):
    return b"".join(b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nwarc-record-id: <urn:%d>\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n"
                    for i, b in enumerate(blocks))


def normalised(spark, tmp_path, raw):
    (tmp_path / "f.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([(str(tmp_path / "f.warc.gz"),)], "archive string")
    return warc.read(warc.normalise(archives, str(tmp_path / "out")))


@pytest.mark.parametrize("pack", [
    lambda raw: gzip.compress(raw),
    lambda raw: gzip.compress(raw[:100]) + gzip.compress(raw[100:]),                      # members that cut records
    lambda raw: b"".join(gzip.compress(raw[i:i + 7]) for i in range(0, 700, 7)) + gzip.compress(raw[700:]),
    lambda raw: gzip.compress(raw) + b"\0" * 200_000,                                     # padding
    lambda raw: gzip.compress(raw[:50]) + b"\0" * 70_000 + gzip.compress(raw[50:]),
    lambda raw: gzip.compress(b"\r\n\r\n" + raw + b"\r\n" * 9)])
def test_foreign_archives(spark, tmp_path, pack):
    blocks = [b"", b"plain block", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>", b"\0" * 3_000_000, b"\r\n\r\n\r\n"]
    got = {r.record_id: r.payload for r in normalised(spark, tmp_path, pack(foreign(*blocks))).collect()}
    assert got == dict(zip([f"<urn:{i}>" for i in range(5)], [b"", b"plain block", b"<html>", b"\0" * 3_000_000, b"\r\n\r\n\r\n"]))


def test_nothing_in_the_file(spark, tmp_path):
    assert normalised(spark, tmp_path, b"").collect() == []


@pytest.mark.parametrize("raw", [gzip.compress(foreign(b"x" * 1000))[:-12], gzip.compress(foreign(b"x" * 1000)[:-600]), gzip.compress(b"no record\r\n\r\n"),
                                 b"no gzip at all", gzip.compress(b"endless" * 400_000)])
def test_broken_archives(spark, tmp_path, raw):
    with pytest.raises(Exception, match="f.warc.gz"):
        normalised(spark, tmp_path, raw).collect()


def test_memory_does_not_grow_with_the_record(tmp_path):
    import tracemalloc
    with gzip.open(tmp_path / "big.warc.gz", "wb", 1) as f:
        f.write(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (200 << 20))
        for _ in range(200):
            f.write(b"a" * (1 << 20))
        f.write(b"\r\n\r\n")
    tracemalloc.start()
    sizes = [size for _, _, _, size in warc.members(str(tmp_path / "big.warc.gz"), lambda b: None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [200 << 20] and peak < 16 << 20
