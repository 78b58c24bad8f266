"""Image files: written and read whole, decoded to pixels in Arrow batches, and measured.

Executors write files through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import first_match
from ashlar.operators.udfs import apply_struct

# ---- fixed values
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by PNG colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bits a sample that each PNG colour type allows.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: A hue in degrees has the name of the first limit above it.
HUES = [(15, "red"), (40, "orange"), (70, "yellow"), (170, "green"), (260, "blue"), (300, "purple"), (345, "pink"), (360, "red")]
#: Below this saturation a colour is black, white or gray, by its value.
PALE, DARK, LIGHT = 0.25, 0.3, 0.85
#: Deflate makes at most this many bytes of one.
DEFLATE_RATIO = 1032


def _unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters on rows (height, width, bytes a pixel).

    A pixel needs its left, upper and upper left ones, so the pixels of one
    diagonal are made at once, those of each row by its own filter.
    """
    height, width, _ = rows.shape
    out = np.zeros((height + 1, width + 1, rows.shape[2]), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        far = [np.abs(guess - near) for near in (left, up, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        kind = np.broadcast_to(kinds[y, None], left.shape)
        out[y + 1, x + 1] = (rows[y, x] + np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])) & 255
    return out[1:, 1:].astype(np.uint8)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_MAGIC)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", data, at + 8 + size)
        if zlib.crc32(kind + body) != crc:
            raise ValueError("checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def _png(data: bytes) -> np.ndarray:
    palette, packed, head = None, [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or not width or not height or depth not in DEPTHS[colour]:
        raise ValueError("not supported")
    line = (width * depth * SAMPLES[colour] + 7) // 8
    size, flat = height * (line + 1), b"".join(packed)
    if size > DEFLATE_RATIO * len(flat) + 64:  # more than the data can hold: nothing is allocated for it
        raise ValueError("too short")
    raw = np.frombuffer(zlib.decompressobj().decompress(flat, size), np.uint8)
    if len(raw) != size:
        raise ValueError("too short")
    raw = raw.reshape(height, line + 1)
    if raw[:, 0].max() > 4:
        raise ValueError("filter")
    step = max(1, depth * SAMPLES[colour] // 8)
    lines = _unfilter(raw[:, 1:].reshape(height, line // step, step).astype(np.int16), raw[:, 0].astype(np.int64)).reshape(height, line)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        values = bits @ (1 << np.arange(depth - 1, -1, -1))
        lines = values if colour == 3 else (values * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = lines.reshape(height, width, -1)[..., :: 2 if depth == 16 else 1]
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if colour in (0, 4) else pixels[..., :3]


def _bmp(data: bytes) -> np.ndarray:
    (at,) = struct.unpack_from("<I", data, 10)
    _, width, height, _, depth, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or depth not in (24, 32) or width <= 0 or not height:
        raise ValueError("not supported")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * line, at).reshape(abs(height), line)
    pixels = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[..., 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels (height, width, 3) of a PNG (all colour types and depths, not interlaced; alpha is left out, of 16 bits the upper 8 count) or a BMP (24 or 32 bits, not packed); None for null, broken and other files."""
    try:
        if data is None or not (data.startswith(PNG_MAGIC) or data.startswith(b"BM")):
            return None
        return _png(data) if data.startswith(PNG_MAGIC) else _bmp(data)
    except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
        return None


def _filtered(pixels: np.ndarray) -> bytes:
    """The lines of an RGB picture, filtered by each of PNG's filters in turn."""
    padded = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, 3), np.int16)
    padded[1:, 1:] = pixels
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    kinds = np.arange(len(pixels)) % 5
    by = np.stack([np.zeros_like(left), left, up, (left + up) >> 1, paeth])[kinds, np.arange(len(pixels))]
    lines = ((padded[1:, 1:] - by) & 255).astype(np.uint8).reshape(len(pixels), -1)
    return np.concatenate([kinds[:, None].astype(np.uint8), lines], axis=1).tobytes()


def encode_png(pixels: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(_filtered(pixels))) + chunk(b"IEND", b"")


def encode_images(pixels: str | Column, width: str | Column) -> Column:
    """PNG files of arrays of r, g, b bytes, row by row; null where the pixels aren't whole rows."""

    def encode(flat: pd.Series, across: pd.Series) -> pd.Series:
        whole = lambda p, w: p is not None and w == w and w and w > 0 and len(p) and len(p) % (3 * int(w)) == 0
        return pd.Series([encode_png(np.asarray(p, np.uint8).reshape(-1, int(w), 3)) if whole(p, w) else None for p, w in zip(flat, across, strict=True)], dtype=object)

    encode.__annotations__ = {"flat": pd.Series, "across": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "binary")(pixels, width)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's content as a file of that name (unique) in folder; rows without name or content write none. Returns name and length of what was written.

    A file appears under its name when it is whole, so a task that runs twice leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            done = []
            for label, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if label is None or data is None:
                    continue
                hidden = f"{path}/_{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(data)
                system.move(hidden, f"{path}/{label}")
                done.append((label, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "length"])

    return df.select(F.col(name).cast("string"), F.col(content)).mapInArrow(write, "name string, length long")


def decode_images(df: DataFrame, content: str) -> DataFrame:
    """df with width, height and pixels (r, g, b bytes, row by row) of image files; all null for null, broken and unknown ones."""

    def measure(column: pd.Series) -> pd.DataFrame:
        found = [decode(data) for data in column]
        return pd.DataFrame({"width": pd.Series([None if p is None else p.shape[1] for p in found], dtype="Int32"), "height": pd.Series([None if p is None else p.shape[0] for p in found], dtype="Int32"), "pixels": pd.Series([None if p is None else np.ascontiguousarray(p, np.uint8).tobytes() for p in found], dtype=object)})

    return apply_struct(df, [content], measure, "width int, height int, pixels binary")


def picture_features(df: DataFrame, pixels: str) -> DataFrame:
    """df with colour, hex, brightness and saturation (percent) of the dominant colour: the mean of the pixels in the fullest cell of 8 levels a channel (the first such, by r, g, b). pixels: binary of r, g, b bytes; null or none give nulls."""

    def dominant(column: pd.Series) -> pd.DataFrame:
        out = np.full((len(column), 3), np.nan)
        for i, flat in enumerate(column):
            rgb = np.frombuffer(flat or b"", np.uint8)
            if len(rgb) >= 3:
                rgb = rgb[: len(rgb) // 3 * 3].reshape(-1, 3).astype(np.int64)
                cell = (rgb >> 3) @ np.array([1024, 32, 1])
                out[i] = rgb[cell == np.bincount(cell).argmax()].mean(axis=0)
        return pd.DataFrame(out, columns=["_r", "_g", "_b"])

    found = apply_struct(df, [pixels], dominant, "_r double, _g double, _b double").withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("_r", "_g", "_b")})
    r, g, b = F.col("_r"), F.col("_g"), F.col("_b")
    high = F.greatest(r, g, b)
    spread = high - F.least(r, g, b)
    some = F.nullif(spread, F.lit(0.0))
    hue = F.coalesce(60 * F.when(r == high, F.pmod((g - b) / some, F.lit(6.0))).when(g == high, (b - r) / some + 2).otherwise((r - g) / some + 4), F.lit(0.0))
    saturation, value = F.coalesce(spread / F.nullif(high, F.lit(0.0)), F.lit(0.0)), high / 255
    pale = saturation < PALE
    colour = first_match([("black", pale & (value < DARK)), ("white", pale & (value > LIGHT)), ("gray", pale), *((name, hue < limit) for limit, name in HUES)])
    code = F.format_string("#%02x%02x%02x", *(F.rint(c).cast("int") for c in (r, g, b)))
    made = {"colour": colour, "hex": code, "brightness": F.round(value * 100, 1), "saturation": F.round(saturation * 100, 1)}
    return found.select(*df.columns, *(F.when(r.isNotNull(), c).alias(name) for name, c in made.items()))
