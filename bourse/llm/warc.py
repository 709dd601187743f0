"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or compressed; one
frame per WARC record follows.  The reader walks frames by their block headers, so it never decodes across a
record's end, decodes each frame by itself and checks it: version line, required headers, Content-Length against
the block, the HTTP length and payload digest against the payload.

Archives are rows (archive, content) of bounded size in a table, which any store can hold; `read_archives` takes
such rows or what Spark's binaryFile source gives for .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm.common import col, pieces

#: fixed values of the formats
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: an archive is closed once it has this many bytes
ARCHIVE_BYTES = 4 << 20
DICT_BYTES, DICT_SAMPLES, SAMPLE_CHARS = 32 << 10, 64, 16 << 10
#: a record may not claim to be larger than this
RECORD_BYTES = 1 << 31
DATE = "2025-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def header_value(text: str | None) -> str:
    """Text that fits on a header line: control characters become %XX."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id, url, size: int, digest: str, refers_to, payload: bytes | None, date: str = DATE) -> bytes:
    """A response record with its payload, or without a payload a revisit record of page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """A dictionary trained on the first SAMPLE_CHARS characters of about DICT_SAMPLES pages, drawn by a hash of the id.

    Empty where there is too little to train on; archives then have no dictionary frame.
    """
    step = max(1, pages.count() // DICT_SAMPLES)
    some = pages.where(F.pmod(F.xxhash64(col(id_col)), F.lit(step)) == 0).select(F.substring(col(html_col), 1, SAMPLE_CHARS).alias("t"))
    texts = sorted(r.t.encode() for r in some.collect() if r.t) if step > 1 or not pages.isEmpty() else []
    # a trainer wants many small samples
    texts = [t[i:i + 1024] for t in texts for i in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes() if len(texts) > 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dict_bytes: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dict_bytes) if dict_bytes else b""
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed if packed else b""


def classified(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, size, refers_to, html): html is NULL for revisits.

    Pages are matched by SHA-256 and length.  The responses are found by (digest,
    id), which no two pages of a group share; only narrow rows meet by digest alone.
    """
    payload = F.coalesce(col(html_col), F.lit(""))
    rows = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"), payload.alias("html"),
                        F.octet_length(payload).cast("bigint").alias("size"), F.sha2(payload.cast("binary"), 256).alias("sha"),
                        F.sha1(payload.cast("binary")).alias("sha1"))
    large = rows.where(F.col("size") >= min_bytes)
    first = large.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    f = first.withColumnsRenamed({"sha": "fsha", "size": "fsize"})
    same = (F.col("sha") == F.col("fsha")) & (F.col("size") == F.col("fsize"))
    responses = large.join(f, same & F.col("page_id").eqNullSafe(F.col("first")), "left_semi")
    responses = responses.unionByName(rows.where(F.col("size") < min_bytes))
    revisits = large.drop("html").join(f, same).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return responses.select("page_id", "url", "size", "sha1", F.lit(None).cast("bigint").alias("refers_to"), "html").unionByName(
        revisits.select("page_id", "url", "size", "sha1", F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("html")))


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   dict_bytes: bytes | None = None) -> DataFrame:
    """(archive, content): every row of `pages` as one record.

    Of pages with equal payloads of at least `min_bytes` bytes the one with the
    smallest id becomes the response, others revisit it; rows that share that id
    are all responses.  NULL html is an empty payload, a NULL url an empty one, and
    pages without an id come after all others (all responses if there is no other).
    """
    dict_bytes = dictionary(pages, id_col, html_col) if dict_bytes is None else dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressionDict(dict_bytes) if dict_bytes else None
        packer, head = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True), dictionary_frame(dict_bytes)
        part, made, frames, size = TaskContext.get().partitionId(), 0, [head], 0

        def close():
            name = f"part-{part:06d}-{made:06d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(frames)], pa.binary())], ["archive", "content"])

        for b in pieces(batches):
            for page_id, url, n, sha1, refers_to, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                payload = None if html is None else html.encode()
                frames.append(packer.compress(record(page_id, url, n, digest, refers_to, payload)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    made, frames, size = made + 1, [head], 0
        if size:
            yield close()

    return classified(pages, min_bytes, id_col, url_col, html_col).mapInArrow(run, "archive string, content binary")


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its headers."""
    if len(raw) < at + 5 or struct.unpack_from("<I", raw, at)[0] != FRAME:
        raise ValueError("no Zstandard frame")
    kind = raw[at + 4]
    single, checksum = kind >> 5 & 1, kind >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
    while True:
        if len(raw) < at + 3:
            raise ValueError("cut block header")
        block = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(raw):
        raise ValueError("cut frame")
    return at


def load_dictionary(raw: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """(dictionary, first byte after its frame) of an archive"""
    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != SKIPPABLE:
        return None, 0
    end = 8 + struct.unpack_from("<I", raw, 4)[0]
    if end > len(raw):
        raise ValueError("cut dictionary frame")
    data = bytes(raw[8:end])
    if data[:4] == struct.pack("<I", FRAME):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data[:4] != struct.pack("<I", DICTIONARY):
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(data), end


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        out[name.lower()] = value.strip()
    return first, out


def parse(raw: bytes) -> dict:
    """The fields of one record; ValueError where something does not hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of headers")
    version, h = headers(head)
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"version line {version[:40]!r}")
    if missing := [x for x in REQUIRED if x.lower() not in h]:
        raise ValueError(f"no {missing[0]}")
    if not h["content-length"].isdecimal() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the block")
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"page_id": int(h["page-id"]) if "page-id" in h else None, "record_type": kind, "url": h.get("warc-target-uri"),
           "payload_digest": digest, "payload_bytes": None, "refers_to": None, "payload": None}
    if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
        _, inner = headers(http)
        if not gap or not inner.get("content-length", "").isdecimal():
            raise ValueError("HTTP headers without a length")
        out["payload_bytes"] = int(inner["content-length"])
        if kind == "revisit":
            if payload or "warc-refers-to" not in h:
                raise ValueError("a revisit has a payload or refers to nothing")
            out["refers_to"] = int(h["refers-to-page-id"]) if "refers-to-page-id" in h else None
        else:
            if len(payload) != out["payload_bytes"]:
                raise ValueError("the payload is not as long as its headers say")
            if payload_digest(payload) != digest:
                raise ValueError("the payload does not fit its digest")
            out["payload"] = payload
    return out


def records(content: bytes) -> Iterator[tuple[int, dict | None, str | None]]:
    """(offset, fields, problem) of every record; a frame that cannot be walked ends the archive."""
    raw = memoryview(content)
    at = 0
    try:
        own, at = load_dictionary(raw)
        unpacker = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
        while at < len(raw):
            if len(raw) >= at + 8 and struct.unpack_from("<I", raw, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
                continue
            end = frame_end(raw, at)
            try:
                size = zstandard.get_frame_parameters(raw[at:at + 18]).content_size
                if size != zstandard.CONTENTSIZE_UNKNOWN and size > RECORD_BYTES:
                    raise ValueError(f"a record of {size} bytes")
                yield at, parse(unpacker.decompressobj().decompress(raw[at:end])), None
            except (ValueError, zstandard.ZstdError) as e:
                yield at, None, str(e)
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        yield at, None, str(e)


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content", payload: bool = False) -> DataFrame:
    """One row per record: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, position, problem[, payload]).

    A record that does not hold has its `problem` named and all else NULL.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            if (content := b.column(1)[0].as_py()) is None:
                continue
            rows = []
            for at, fields, problem in records(content):
                if fields is not None and not payload:
                    fields["payload"] = None
                rows.append((at, fields or {}, problem))
            cols = [pa.array([r[1].get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
            cols += [pa.array([b.column(0)[0].as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.string())]
            if payload:
                cols.append(pa.array([r[1].get("payload") for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*names, "archive", "position", "problem", *["payload"] * payload])

    return archives.select(col(name_col).alias("archive"), col(content_col).alias("content")).mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, "
             "archive string, position bigint, problem string" + ", payload binary" * payload)


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
        lambda i: substr('{_CHARS}', ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
