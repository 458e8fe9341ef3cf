"""WARC in seekable Zstandard bundles.

Every page becomes a WARC/1.1 record. Equal payloads of at least ``LEAST`` bytes are stored once: the smallest
page_id is the response, the others are revisits that name it. Records are packed into bundles: groups of records
share an independent Zstandard frame, and a bundle ends with a skippable frame holding the seek table (compressed and
plain size of each frame). A second table maps record identifiers to bundle, frame and offset in the frame's plain
bytes. Both are tables in the shared folder: a bundle is one row with its bytes, as Spark has no binary file sink.

Reading goes through the index: the frame is found by the seek table, decompressed alone, and the record is parsed at
its offset.

Cases: null html is an empty payload; null url leaves the target out; line feeds in a url are percent-encoded;
repeated rows each get a record; among equal payloads with the same smallest page_id each such row is a response;
null page_ids are never referred to unless no other row has the payload; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, small

LEAST, FRAME = 100, 1 << 18
#: A bundle ends with the record that reaches one of these: its stored bytes, its plain bytes, its records.
BUNDLE, PLAIN, RECORDS = 1 << 24, 1 << 27, 20_000
SKIP, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(page_id, url, payload: bytes, digest: str, size: int, refers) -> bytes:
    kind = "response" if refers is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers is None else b""
    return "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(plain: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that starts at ``at``."""
    end = plain.index(b"\r\n\r\n", at)
    version, *lines = plain[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    return headers, plain[end + 4 : end + 4 + size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIP, len(body)) + body


def frame_starts(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    n, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, start = [], 0
    for c, d in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n : len(bundle) - 9]):
        out.append((start, c, d))
        start += c
    return out


def _bundles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    data, frames, plain, index = bytearray(), [], bytearray(), []

    def close_frame() -> None:
        if plain:
            packed = pack.compress(bytes(plain))
            frames.append((len(packed), len(plain)))
            data.extend(packed)
            plain.clear()

    def close() -> pd.DataFrame:
        close_frame()
        content = bytes(data) + seek_table(frames)
        row = pd.DataFrame({"bundle": [hashlib.sha256(content).hexdigest()], "content": [content], "records": [list(index)]})
        data.clear()
        frames.clear()
        index.clear()
        return row

    for part in parts:
        for r in part.itertuples(index=False):
            key, refers = (None if x is None else int(x) for x in (r.page_id, r.refers_to))
            payload = b"" if r.html is None else r.html.encode()
            index.append({"page_id": key, "frame": len(frames), "offset": len(plain)})
            plain += record(key, r.url, payload, r.payload_digest, len(payload), refers)
            if len(plain) >= FRAME:
                close_frame()
            if len(data) >= BUNDLE or len(index) >= RECORDS or sum(n for _, n in frames) >= PLAIN:
                yield close()
    if index:
        yield close()


def write_bundles(pages: DataFrame) -> DataFrame:
    """Write all records; the table of (bundle, content, records<page_id, frame, offset>) as it was stored."""
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    rows = pages.select("page_id", "url", "html", digest.alias("payload_digest"), (F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST).alias("long"))
    shared = rows.where("long").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = small(cut(shared.select(F.col("payload_digest").alias("d"), "first")))
    told = rows.join(firsts, F.col("payload_digest") == F.col("d"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # as text, for a nullable column of whole numbers would pass through floats in a worker
    told = told.select(F.col("page_id").cast("string"), "url", "html", "payload_digest", refers.cast("string").alias("refers_to"))
    return cut(told.mapInPandas(_bundles, "bundle string, content binary, records array<struct<page_id:bigint,frame:int,offset:bigint>>"))


def record_index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, offset) of every record."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.offset")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for part in parts:
        for content, records in part.itertuples(index=False):
            frames, held, plain, out = frame_starts(content), None, b"", []
            for r in records:
                if r["frame"] != held:
                    start, c, d = frames[held := r["frame"]]
                    plain = unpack.decompress(content[start : start + c], max_output_size=d)
                headers, block = parse(plain, r["offset"])
                name = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                key = name or None
                if headers["WARC-Type"] == "response":
                    out.append((key, len(block), hashlib.sha256(block).hexdigest(), "response", None))
                else:
                    out.append((key, int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", headers["WARC-Refers-To"][len("<urn:page:") : -1]))
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the bundles."""
    found = bundles.select("content", "records").mapInPandas(_read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")}).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
