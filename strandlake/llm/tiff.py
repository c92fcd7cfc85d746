"""TIFF media columns (operator 5).

`tiff_pages` walks the image directories of each file, reads strips or tiles (raw, PackBits, LZW, deflate), undoes the
horizontal predictor and gives one row per page. `store_as_tiff` is the way in: bytes as rows of 8-bit samples.

Defined results: null media has no pages; a damaged file gives one row with page -1 and what went wrong in `error`;
repeated rows give equal pages; columns that are not asked for are not carried, so clashing names cannot arise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow

WIDTH = 64  # samples in a row of a stored payload; also what payloads are padded to a multiple of

# Tag numbers, compression schemes and field types of the format.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and the text followed by zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of two or more as (1 - n, byte), the rest as (n - 1, bytes), up to 128 each."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW as the format has it: codes from 9 to 12 bits, highest bit first, widths growing one code early."""
    acc = bits = 0
    out, table, width, word = bytearray(), {}, 9, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    def fresh() -> dict:
        return {bytes([i]): i for i in range(256)} | {None: 256, "": 257}

    put(256)
    table = fresh()
    for x in data:
        if (longer := word + bytes([x])) in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table)
        word = bytes([x])
        if len(table) == 4095:
            put(256)
            table, width = fresh(), 9
        elif len(table) in (512, 1024, 2048):
            width += 1
    if word:
        put(table[word])
        if len(table) + 1 in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, last = bytearray(), [], 9, b""
    acc = bits = 0
    for x in data:
        acc, bits = (acc << 8 | x) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif last and code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) + 1 in (512, 1024, 2048):
            width += 1
    return bytes(out)


CODERS = {RAW: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}
DECODERS = {RAW: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def tiff_of(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with one page for each image (height x width or height x width x samples, uint8). tile: (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for im in images:
        im = im[:, :, None] if im.ndim == 2 else im
        h, w, s = im.shape
        if tile:
            grid = np.zeros((-(-h // tile[0]) * tile[0], -(-w // tile[1]) * tile[1], s), np.uint8)
            grid[:h, :w] = im
            parts = [grid[y : y + tile[0], x : x + tile[1]] for y in range(0, h, tile[0]) for x in range(0, w, tile[1])]
        else:
            parts = [im[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for p in parts:
            if predictor == 2:
                p = p.copy()
                p[:, 1:] -= p[:, :-1].copy()
            data = CODERS[compression](np.ascontiguousarray(p).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data + bytes(len(data) % 2)
        tags = [(IMAGE_WIDTH, 4, [w]), (IMAGE_LENGTH, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if s < 3 else 2]), (SAMPLES, 3, [s]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + bytes(len(body) % 2)
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, values by tag) of each image directory; a chain that loops is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, e := at + 2 + 12 * i)
            if (code := FIELD.get(kind)) is not None:
                size = struct.calcsize(code) * count
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0])
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages_of(data: bytes) -> Iterator[np.ndarray]:
    """Samples of each page, height x width x samples."""
    for order, t in directories(data):
        one = lambda tag, default: t.get(tag, (default,))[0]
        w, h, s, scheme, predictor = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
        bits = set(t.get(BITS, (1,)))
        if bits not in ({8}, {16}) or scheme not in DECODERS or predictor not in (1, 2):
            raise ValueError(f"not supported: bits {sorted(bits)}, compression {scheme}, predictor {predictor}")
        kind = np.dtype("u1") if bits == {8} else np.dtype(order + "u2")
        planes = s if one(PLANAR, 1) == 2 else 1
        deep = s // planes
        tiled = TILE_OFFSETS in t
        ph, pw = (t[TILE_LENGTH][0], t[TILE_WIDTH][0]) if tiled else (min(one(ROWS_PER_STRIP, h), h) or 1, w)
        offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[STRIP_OFFSETS], t[STRIP_COUNTS])
        across, down = -(-w // pw), -(-h // ph)
        page = np.zeros((h, w, s), kind)
        for i, (at, size) in enumerate(zip(offsets, counts, strict=True)):
            plane, k = divmod(i, across * down)
            y, x = k // across * ph, k % across * pw
            raw = np.frombuffer(DECODERS[scheme](data[at : at + size]), kind)
            tall = ph if tiled else min(ph, h - y)
            part = raw[: tall * pw * deep].reshape(tall, pw, deep)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            page[y : y + tall, x : x + pw, plane * deep : (plane + 1) * deep] = part[: h - y, : w - x]
        yield page


def feature_of(page: np.ndarray) -> str:
    """Integer statistics of a page: size, mean and spread in thousandths, changes along rows, and a 64-bit hash of which
    of 64 equal stretches of samples lie above the mean."""
    flat = page.reshape(-1).astype(np.int64)
    n = max(1, len(flat))
    mean = int(flat.sum()) * 1000 // n
    spread = (int((flat * flat).sum()) * 1000 // n) - mean * mean // 1000
    changes = int((page[:, 1:] != page[:, :-1]).sum())
    cuts = np.arange(64) * len(flat) // 64
    above = [int(a) * 1000 > mean * max(1, int(b)) for a, b in zip(np.add.reduceat(flat, np.minimum(cuts, n - 1)), np.diff(np.append(cuts, len(flat))))] if len(flat) else []
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]} mean {mean} spread {spread} changes {changes} hash {int(''.join('01'[x] for x in above) or '0', 2):016x}"


def store_as_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE) -> DataFrame:
    """id_col, n_bytes and media per row: the padded text as one page of WIDTH samples a row, predictor on."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    n, payload = padded(text)
                    sizes.append(n)
                    media.append(tiff_of([np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)], compression, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def tiff_pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, page, width, height, samples, pixels (binary), feature and error: one row per page of each file."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                at, rows = [], []
                for i, data in enumerate(part.column(b.num_columns - 1).to_pylist()):
                    if data is None:
                        continue
                    try:
                        found = [(j, p.shape[1], p.shape[0], p.shape[2], p.tobytes(), feature_of(p), None) for j, p in enumerate(pages_of(data))]
                    except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                        found = [(-1, None, None, None, None, None, str(e))]
                    at += [i] * len(found)
                    rows += found
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                kept = [part.column(c).take(pa.array(at, pa.int64())) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, kinds))], [*(f"k{c}" for c in range(len(keep))), "page", "width", "height", "samples", "pixels", "feature", "error"])

    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "page int, width int, height int, samples int, pixels binary, feature string, error string"])
    out = map_arrow(df.select(*keep, media_col), run, schema)
    return out.toDF(*keep, *out.columns[len(keep) :])


def text_media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as TIFF, reads the stored bytes back, and returns digests of both and features of the page."""
    stored = store_as_tiff(df, id_col, text_col).select(id_col, "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(stored, "media", (id_col, "n_bytes", "media_bytes", "media_sha256"))
    return pages.select(
        id_col, "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pixels, length(pixels) - {WIDTH - 1}, {WIDTH})")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
