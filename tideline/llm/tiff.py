"""TIFF columns: write bytes as multi-page TIFF, walk image directories and emit one row per page.

The reader takes both byte orders, strips and tiles, PackBits, LZW and deflate (or none), 8-bit samples, chunky
configuration, and the horizontal predictor. The writer stores a payload losslessly as gray pages of ``WIDTH``
columns. Codec (PackBits, LZW or deflate), horizontal predictor (not with PackBits) and layout (strips or tiles) go by
the payload's checksum, so texts of every length meet each of them and equal texts get equal files. Python
functions run over Arrow batches; each handles one image at a time and yields pages as they are decoded, so memory is
bounded by the largest single image.

Cases: null and empty texts are one block of padding; null or broken media, and such without any page, give one row
with page -1 and the error's name; repeated rows are each handled; the key column may be null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, WIDTH, HEIGHT, TILE = 576, 96, 192, 96
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
PAGE = "page int, pages int, width int, height int, samples int, compression int, predictor int, tiled boolean, n_bytes long, media_bytes long, media_sha256 string, pixels binary, error string"


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    """Runs of three or more as repeats, everything else as literals of at most 128 bytes."""
    out, literal = bytearray(), 0
    x = np.frombuffer(row, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    long = np.flatnonzero(np.diff(starts) >= 3)

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            b = min(a + 128, end)
            out.append(b - a - 1)
            out.extend(row[a:b])

    for at, end in zip(starts[long].tolist(), starts[long + 1].tolist(), strict=True):
        flush(at)
        while end - at >= 3:
            n = min(end - at, 128)
            out.append(257 - n)
            out.append(row[at])
            at += n
        literal = at  # one or two bytes of a long run may be left
    flush(len(row))
    return bytes(out)


def pack_rows(part: np.ndarray) -> bytes:
    """PackBits of each row by itself, as the format asks; rows without runs are literals at once."""
    if part.shape[1] > 128:
        return b"".join(pack_bits(r.tobytes()) for r in part)
    same = part[:, 1:] == part[:, :-1]
    runs = (same[:, 1:] & same[:, :-1]).any(1)
    plain = np.hstack([np.full((len(part), 1), part.shape[1] - 1, np.uint8), part])
    if not runs.any():
        return plain.tobytes()
    return b"".join(pack_bits(r.tobytes()) if run else p.tobytes() for r, run, p in zip(part, runs, plain, strict=True))


#: Codes after a clear code until the table is full, and the width of each: it grows one code early, as the format has it.
FULL = 4095 - 258
WIDTHS = 9 + sum((258 + np.arange(FULL + 1) >= n).astype(np.int64) for n in (512, 1024, 2048))
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits. Codes are found byte by byte in a table keyed by (code, byte), then packed at once."""
    codes, blocks, table, code = [], [], {}, 258
    get = table.get
    if data:
        held = data[0]
        for byte in data[1:]:
            key = held << 8 | byte
            longer = get(key)
            if longer is not None:
                held = longer
                continue
            codes.append(held)
            table[key] = code
            code += 1
            held = byte
            if code == 4095:
                blocks.append(codes)
                codes, code = [], 258
                table.clear()
        codes.append(held)
    blocks.append(codes)
    values, widths = [[256]], [[9]]
    for block in blocks:
        values.append(block)
        widths.append(WIDTHS[: len(block)])
        if block is not blocks[-1]:
            values.append([256])
            widths.append([12])
    values.append([257])
    widths.append([WIDTHS[len(blocks[-1])]])
    values, widths = np.concatenate([np.asarray(v, np.int64) for v in values]), np.concatenate([np.asarray(w, np.int64) for w in widths])
    ends = np.cumsum(widths)
    first = ends - widths
    window = values << (24 - (first & 7) - widths)  # a code lies in three bytes
    at = first >> 3
    out = np.zeros(int(ends[-1] + 7) // 8 + 2, np.int64)
    for i in range(3):
        out += np.bincount(at + i, (window >> (16 - 8 * i)) & 255, len(out)).astype(np.int64)  # bits of codes don't overlap
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(data: bytes) -> bytes:
    """Codes are cut out up to the next clear or end code at once, then looked up one by one."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    raw, bit, out = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 0, []
    while bit + 9 <= 8 * len(data):
        n = int(np.searchsorted(OFFSETS, 8 * len(data) - bit, side="right")) - 1
        at, widths = bit + OFFSETS[:n], WIDTHS[:n]
        byte = at >> 3
        codes = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (at & 7) - widths)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        block = codes[: stops[0] if len(stops) else n].tolist()
        table, held = list(base), None
        for code in block:
            entry = table[code] if code < len(table) else held + held[:1]
            out.append(entry)
            if held is not None:
                table.append(held + entry[:1])
            held = entry
        if not len(stops) or codes[stops[0]] == 257:
            break
        bit = int(at[stops[0]] + widths[stops[0]])
    return b"".join(out)


DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, 32946: zlib.decompress, PACKBITS: unpack_bits}
ENCODE = {NONE: lambda x: x.tobytes(), LZW: lambda x: lzw_encode(x.tobytes()), DEFLATE: lambda x: zlib.compress(x.tobytes(), 1), PACKBITS: pack_rows}


def plan(payload: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and whether tiles are used: by the payload's checksum, whatever its length."""
    h = zlib.crc32(payload)
    compression = (LZW, PACKBITS, DEFLATE)[h % 3]
    return compression, 2 if compression != PACKBITS and h // 3 % 2 else 1, bool(h // 6 % 2)


def write_tiff(payload: bytes, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """Pages of up to ``height`` rows; little-endian, directories after the pixel data of their page."""
    compression, predictor, tiled = plan(payload)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for at in range(0, len(payload), width * height):
        page = np.frombuffer(payload, np.uint8, min(width * height, len(payload) - at), at).reshape(-1, width)
        step = TILE if tiled else max(1, 8192 // width)
        chunks, counts = [], []
        for y in range(0, page.shape[0], step):
            part = page[y : y + step]
            if tiled and len(part) < TILE:
                part = np.vstack([part, np.zeros((TILE - len(part), width), np.uint8)])
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = ENCODE[compression](part)
            chunks.append(len(out))
            counts.append(len(data))
            out += data
        where, n = len(out) + len(out) % 2, len(chunks)
        tags = [(256, 4, [width]), (257, 4, [page.shape[0]]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [TILE]), (323, 4, [TILE]), (324, 4, chunks), (325, 4, counts)] if tiled else [(273, 4, chunks), (278, 4, [step]), (279, 4, counts)]
        directory, extra, spill = bytearray(struct.pack("<H", len(tags))), bytearray(), where + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, extra = struct.pack("<I", spill + len(extra)), extra + raw
            directory += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (where - len(out))
        struct.pack_into("<I", out, link, where)
        link = where + len(directory)
        out += directory + b"\0\0\0\0" + extra
    return bytes(out)


def read_pages(media: bytes) -> Iterator[dict]:
    """Width, height, samples, compression, predictor, tiled and pixels of every page, following the directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}[media[:4]]
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", media, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
            form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", media, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{form}", media, where)
        get = lambda tag, default=None, t=tags: t.get(tag, (default,))[0]
        width, height, samples = get(256), get(257), get(277, 1)
        if set(tags.get(258, (8,))) != {8} or get(284, 1) != 1:
            raise ValueError("only 8-bit chunky samples")
        decode, predictor, tiled = DECODE[get(259, 1)], get(317, 1), 324 in tags
        w, h = (get(322), get(323)) if tiled else (width, get(278, height))
        across = -(-width // w)
        image = np.zeros((-(-height // h) * h, across * w, samples), np.uint8)
        for k, (a, c) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            raw = decode(media[a : a + c])
            part = np.frombuffer(raw, np.uint8, rows * w * samples).reshape(rows, w, samples)
            if predictor == 2:
                part = np.add.accumulate(part, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + w] = part
        yield {"width": width, "height": height, "samples": samples, "compression": get(259, 1), "predictor": predictor, "tiled": tiled, "pixels": image[:height, :width].tobytes()}
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)


def _encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for at in range(0, len(part), 64):
            out = []
            for key, text in part.iloc[at : at + 64].itertuples(index=False):
                data = b"" if text is None else text.encode()
                size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
                out.append((key, len(data), write_tiff(data.ljust(size, b"\xff"))))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "media"])


def _mapped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``rows`` through ``run``; ids go as text, for a nullable column of whole numbers would pass through floats in a worker."""
    kind = rows.schema["doc_id"].dataType
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, " + schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def to_tiff(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF."""
    return _mapped(documents.select("doc_id", "text"), _encode, "n_bytes long, media binary")


def _pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", *(x.split()[0] for x in PAGE.split(", "))]
    for part in parts:
        out, held = [], 0
        for key, n_bytes, media in part.itertuples(index=False):
            same = {"doc_id": key, "n_bytes": n_bytes, "media_bytes": 0 if media is None else len(media), "media_sha256": None if media is None else hashlib.sha256(media).hexdigest()}
            try:
                pages = list(read_pages(media))
                if not pages:
                    raise ValueError("no page")
                out += [same | p | {"page": i, "pages": len(pages)} for i, p in enumerate(pages)]
            except Exception as e:
                out.append(same | {"page": -1, "pages": 0, "error": type(e).__name__})
            held += same["media_bytes"]
            if held > 1 << 20:
                yield _typed(out, names)
                out, held = [], 0
        if out:
            yield _typed(out, names)


def _typed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows).reindex(columns=names)
    whole = ["page", "pages", "width", "height", "samples", "compression", "predictor", "n_bytes", "media_bytes"]
    return frame.astype({c: "Int64" for c in whole} | {"tiled": "boolean"}).astype({c: object for c in ("pixels", "error", "media_sha256")}).where(frame.notna(), None)


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row per page of each (doc_id, n_bytes, media); pages of an image come one after another."""
    return _mapped(media.select("doc_id", "n_bytes", "media"), _pages, PAGE)


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = None
    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            if r.page <= 0:
                sha, size, tail, total, squares, counts, layout = hashlib.sha256(), 0, b"", 0, 0, np.zeros(256, np.int64), []
            if r.page >= 0:
                data = bytes(r.pixels)
                sha.update(data)
                size, tail = size + len(data), (tail + data[-32:])[-32:]
                counts += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                layout.append((int(r.compression), int(r.predictor), bool(r.tiled)))
            if r.page == r.pages - 1 or r.page < 0:
                levels = np.arange(256)
                n = max(1, int(counts.sum()))
                mean, squares = int((counts * levels).sum()) * 1000 // n, int((counts * levels * levels).sum()) * 1000 // n
                kinds = "+".join(f"{c}.{p}.{'t' if t else 's'}" for c, p, t in dict.fromkeys(layout))
                feature = f"pages={int(r.pages)};layout={kinds};mean={mean};square={squares};levels={int((counts > 0).sum())};mode={int(counts.argmax())}"
                out.append((r.doc_id, r.n_bytes, size, sha.hexdigest(), zlib.crc32(tail), r.media_bytes, r.media_sha256, feature if r.page >= 0 else f"error={r.error}"))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digest_pages(pages: DataFrame) -> DataFrame:
    """One row per image from its consecutive page rows: digests of what was read back, and features."""
    return _mapped(pages, _digests, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
