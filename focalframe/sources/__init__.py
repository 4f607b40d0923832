"""Frames from and to PNG and TIFF files: headers, pixels (RGB, 8 and 16 bits, floats in TIFF) by Arrow kernels, files made and read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_headers(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with width, height, bit_depth, colour and whether the signature fits; pixels are not read."""

    def number(at: int, size: int) -> F.Column:
        return F.expr(f"try_cast(conv(hex(substring(content, {at}, {size})), 16, 10) AS int)")

    fits = F.hex(F.substring("content", 1, 8)) == SIGNATURE.hex().upper()
    return files.select("path", fits.alias("is_png"), number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).alias("bit_depth"), number(26, 1).alias("colour"))


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) codes; other colour types and interlacing are errors."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if colour != 2 or interlace or bits not in (8, 16):
        raise ValueError(f"only RGB of 8 or 16 bits is read, not colour type {colour}, {bits} bits, interlace {interlace}")
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    step, line = 3 * bits // 8, width * 3 * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        kind, row, above = raw[y, 0], raw[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            out[y + 1] = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = row + above
        else:
            new = out[y + 1]
            for x in range(line):
                left, corner = (int(new[x - step]), int(above[x - step])) if x >= step else (0, 0)
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                new[x] = (int(row[x]) + guess) & 255
    pixels = np.ascontiguousarray(out[1:])
    return (pixels.view(">u2").astype(np.int64) if bits == 16 else pixels.astype(np.int64)).reshape(height, width, 3)


def encode_png(image: np.ndarray, bits: int = 16) -> bytes:
    """A PNG of values clamped to [0, 1], rounded half up."""
    codes = np.floor(np.clip(image, 0, 1) * ((1 << bits) - 1) + 0.5).astype(">u2" if bits == 16 else np.uint8)
    height, width = codes.shape[:2]
    lines = np.zeros((height, 1 + width * 3 * bits // 8), np.uint8)
    lines[:, 1:] = codes.reshape(height, -1).view(np.uint8)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, bits, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


#: TIFF field types as struct codes, and the tags that are read or written.
TIFF_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ORIENTATION, CHANNELS, STRIP_ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 274, 277, 278, 279, 317, 339


def tiff_fields(fetch: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple[int, ...]]]:
    """The byte order of a TIFF file, and the whole-number tags of its first image; ``fetch(at, size)`` gives bytes of the file."""
    head = fetch(0, 8)
    if head[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if head[:1] == b"I" else ">"
    at = struct.unpack_from(order + "I", head, 4)[0]
    n = struct.unpack(order + "H", fetch(at, 2))[0]
    entries, tags = fetch(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
        if kind in TIFF_TYPES:
            code = order + TIFF_TYPES[kind] * count
            size = struct.calcsize(code)
            body = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else fetch(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], size)
            tags[tag] = struct.unpack(code, body)
    return order, tags


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    """``tiff_fields`` of a whole file."""
    return tiff_fields(lambda at, size: data[at : at + size])


def decode_tiff(data: bytes) -> np.ndarray:
    """(height, width, 3) samples of an RGB TIFF in strips, plain or deflated: codes, or floats of 32 bits."""
    order, tags = tiff_tags(data)
    bits, packing, form = tags[BITS][0], tags.get(COMPRESSION, (1,))[0], tags.get(FORMAT, (1,))[0]
    if tags.get(CHANNELS, (1,))[0] != 3 or (form, bits) not in ((1, 8), (1, 16), (3, 32)) or packing not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only RGB of 8 or 16 bits or floats, in strips, plain or deflated, is read")
    parts = [data[a : a + n] for a, n in zip(tags[OFFSETS], tags[COUNTS])]
    raw = b"".join(zlib.decompress(p) if packing != 1 else p for p in parts)
    pixels = np.frombuffer(raw, order + ("f4" if form == 3 else f"u{bits // 8}")).reshape(tags[HEIGHT][0], tags[WIDTH][0], 3)
    return pixels.astype(np.float64 if form == 3 else np.int64)


def tiff_head(height: int, width: int, bits: int, strip_rows: int) -> bytes:
    """All that comes before the samples of a plain RGB TIFF, whose strips follow each other."""
    line = width * 3 * bits // 8
    rows = [min(strip_rows, height - y) for y in range(0, height, strip_rows)]
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * 3), (COMPRESSION, 3, [1]), (262, 3, [2]), (OFFSETS, 4, [0] * len(rows)), (CHANNELS, 3, [3]), (STRIP_ROWS, 4, [strip_rows]), (COUNTS, 4, [n * line for n in rows]), (FORMAT, 3, [3 if bits == 32 else 1] * 3)]
    after = 8 + 2 + 12 * len(fields) + 4
    start = after + sum(size for _, kind, values in fields if (size := struct.calcsize("<" + TIFF_TYPES[kind] * len(values))) > 4)
    head, extra = b"", b""
    for tag, kind, values in fields:
        if tag == OFFSETS:
            values = [start + strip_rows * line * k for k in range(len(rows))]
        body = struct.pack("<" + TIFF_TYPES[kind] * len(values), *values)
        if len(body) > 4:
            extra, body = extra + body, struct.pack("<I", after + len(extra))
        head += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + head + b"\0\0\0\0" + extra


def encode_tiff(image: np.ndarray, bits: int = 16) -> bytes:
    """A plain TIFF in one strip: values clamped to [0, 1] and rounded half up, or with 32 bits floats as they are."""
    samples = image.astype("<f4") if bits == 32 else np.floor(np.clip(image, 0, 1) * ((1 << bits) - 1) + 0.5).astype(f"<u{bits // 8}")
    return tiff_head(*image.shape[:2], bits, image.shape[0]) + samples.tobytes()


def jpeg_size(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, channels) from the frame header of a JPEG file."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            bits, height, width, channels = struct.unpack_from(">BHHB", data, at + 4)
            return width, height, bits, channels
        at += 2 + size
    raise ValueError("no frame header")


_PROBED = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("channels", pa.int32()), ("orientation", pa.int32()), ("error", pa.string())])


def _header(data: bytes) -> tuple:
    """(format, width, height, bit depth, channels, orientation) of a PNG, TIFF or JPEG file."""
    if data[:8] == SIGNATURE:
        width, height, bits, colour = struct.unpack(">IIBB", data[16:26])
        return "png", width, height, bits, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], 1
    if data[:2] == b"\xff\xd8":
        return "jpeg", *jpeg_size(data), 1
    _, tags = tiff_tags(data)
    return "tiff", tags[WIDTH][0], tags[HEIGHT][0], tags[BITS][0], tags.get(CHANNELS, (1,))[0], tags.get(ORIENTATION, (1,))[0]


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                rows.append((path, *_header(content.as_buffer().to_pybytes()), None))
            except (ValueError, KeyError, struct.error) as e:
                rows.append((path, *[None] * 6, str(e) or type(e).__name__))
        columns = list(zip(*rows)) or [[]] * len(_PROBED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROBED)], schema=_PROBED)


def probe(files: DataFrame) -> DataFrame:
    """(path, format, width, height, bit_depth, channels, orientation, error) of ``files(path, content)``; files that are none have an error and nulls."""
    return files.select("path", "content").mapInArrow(_probed, "path string, format string, width int, height int, bit_depth int, channels int, orientation int, error string")


def encoded(frames: DataFrame, kind: str = "png", bits: int = 16) -> DataFrame:
    """(frame, content, height, width) of ``frames(frame, y, r, g, b)`` with values to be clamped to [0, 1]: a file for each, opened again and its size checked."""
    encode, decode = {"png": (encode_png, decode_png), "tiff": (encode_tiff, decode_tiff)}[kind]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        bands = [table[c].combine_chunks() for c in "rgb"]
        image = np.stack([b.flatten().to_numpy().reshape(len(b), -1) for b in bands], axis=2).astype(float)
        content = encode(image, bits)
        if decode(content).shape != image.shape:
            raise ValueError(f"frame {key[0].as_py()} was not written whole")
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "content": pa.array([content], pa.binary()), "height": pa.array([image.shape[0]], pa.int32()), "width": pa.array([image.shape[1]], pa.int32())})

    return frames.select("frame", "y", *"rgb").groupBy("frame").applyInArrow(run, "frame int, content binary, height int, width int")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_buffer().to_pybytes()
            image = (decode_png if data[:8] == SIGNATURE else decode_tiff)(data)
            h, w = image.shape[:2]
            ends = pa.array(np.arange(h + 1, dtype=np.int32) * w)
            bands = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(image[:, :, c]).ravel())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * h), pa.array(range(h), pa.int32()), *bands, pa.array([h] * h, pa.int32())], names=["path", "y", "r", "g", "b", "height"])


def read_frames(spark: SparkSession, folder: str, pattern: str = "*.{png,tif,tiff}") -> DataFrame:
    """(frame, path, y, r, g, b, height): rows of pixels of the PNG and integer TIFF files of a folder, numbered by path (of a stack, so few)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    from pyspark.sql import Window

    order = files.select("path").withColumn("frame", F.row_number().over(Window.orderBy("path")) - 1)
    return files.mapInArrow(_decoded, "path string, y int, r array<bigint>, g array<bigint>, b array<bigint>, height int").join(order, "path")


def read_png_frames(spark: SparkSession, folder: str) -> DataFrame:
    """``read_frames`` of the PNG files alone."""
    return read_frames(spark, folder, "*.png")
