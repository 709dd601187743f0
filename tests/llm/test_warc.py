import base64
import hashlib
import struct

import check_oracles as co
import pytest
import zstandard
from pyspark.sql import functions as F

from bourse.llm import warc

SF = "/root/testdata/sf0.001"
KIND = "page_id long, url string, html string"
PAGES = [(i, f"http://x/{i}\r\nEvil: 1", f"<html>{'é' * (i % 7)}{i % 5}</html>" * 20) for i in range(60)] + [
    (60, None, None), (61, "u", ""), (62, "u", "long " * 300_000), (62, "u", "long " * 300_000), (None, "u", "<p>only</p>"),
    (None, None, "<p>only</p>"), (None, "u", f"<html>{'é' * 3}{3}</html>" * 20), (63, "u", "GET / HTTP\r\n\r\nWARC/1.1\r\n")]


def brute(pages, least):
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "").encode() == raw]
        first = min([i for i in ids if i is not None], default=None)
        response = len(raw) < least or page_id == first
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if response else "revisit", None if response else first))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 60, 10 ** 9])
def test_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, KIND).withColumn("size", F.lit("x")).withColumn("sha", F.lit(1))
    got = warc.read_archives(warc.write_archives(df, least), payload=True).collect()
    assert all(r.problem is None for r in got)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(PAGES, least)
    assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in got)
    assert "http://x/3%0D%0AEvil: 1" in {r.url for r in got}


def test_query_equals_its_sql_and_empty_table(spark):
    import __spark_entry__ as entry
    assert co.compare(entry.queries()["op10_warc"](spark, SF), co.duck(SF), warc.SQL) is None
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], KIND))).count() == 0


def archive(spark, n=30):
    df = spark.createDataFrame(PAGES[:n], KIND).coalesce(1)
    return bytes(warc.write_archives(df).first().content)


def test_layout(spark):
    raw = archive(spark)
    magic, size = struct.unpack_from("<II", raw)
    assert magic == warc.SKIPPABLE
    own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(raw[8:8 + size]))
    at, n = 8 + size, 0
    while at < len(raw):  # the library finds the same frames
        d = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
        d.decompress(raw[at:])
        end = len(raw) - len(d.unused_data)
        assert warc.frame_end(memoryview(raw), at) == end
        at, n = end, n + 1
    assert n == 30


def test_plain_dictionary_and_none():
    body = warc.record(1, "u", 3, warc.payload_digest(b"abc"), None, b"abc")
    samples = [warc.record(i, f"u{i}", 3, warc.payload_digest(b"abc"), None, b"abc" * i) for i in range(200)]
    trained = zstandard.train_dictionary(2048, samples)
    frame = zstandard.ZstdCompressor(dict_data=trained).compress(body)
    plain = struct.pack("<II", warc.SKIPPABLE, len(trained.as_bytes())) + trained.as_bytes()
    for raw in (plain + frame, zstandard.ZstdCompressor().compress(body), zstandard.ZstdCompressor(write_content_size=False).compress(body)):
        (_, fields, problem), = warc.records(raw)
        assert problem is None and fields["payload"] == b"abc" and fields["page_id"] == 1


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Data"), (b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 4\r\n\r\nabc"),
                                     (b"abc\r\n\r\n", b"abd\r\n\r\n"), (b"abc\r\n\r\n", b"abc\r\n"), (b"WARC-Type:", b"WARC-Type")])
def test_what_does_not_hold_is_named(old, new):
    body = warc.record(1, "u", 3, warc.payload_digest(b"abc"), None, b"abc")
    good, bad = (zstandard.ZstdCompressor().compress(x) for x in (body, body.replace(old, new)))
    found = list(warc.records(good + bad + good))
    assert [f is not None for _, f, _ in found] == [True, False, True] and found[1][2]


def test_cut_archives(spark):
    raw = archive(spark, 12)
    whole = len(list(warc.records(raw)))
    for cut in range(1, len(raw), 97):
        found = list(warc.records(raw[:cut]))
        assert len(found) <= whole and (not found or sum(p is not None for _, _, p in found) <= 1)
    df = spark.createDataFrame([("a", bytearray(raw[:-5])), ("b", None)], "path string, content binary")
    got = warc.read_archives(df, name_col="path").collect()
    assert len(got) == 12 and [r.problem is not None for r in got] == [False] * 11 + [True]
