"""Image kernels in numpy behind Arrow functions: headers, PNG pixels, hashes, transparency, resizing, stitching.

Formats whose pixels need a native decoder are read for their headers only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def header(data: bytes | None) -> tuple[str, int, int, int] | None:
    """format, width, height and orientation of PNG, GIF, BMP and JPEG data, or None."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]), 1)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]), 1)
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return ("bmp", abs(w), abs(h), 1)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    return None


def _jpeg(data: bytes) -> tuple[str, int, int, int] | None:
    at, orientation = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            orientation = _exif_orientation(data[at + 10 : at + 2 + size])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return None
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("jpeg", h, w, orientation) if orientation >= 5 else ("jpeg", w, h, orientation)
        at += 2 + size
    return None


def _exif_orientation(tiff: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = int.from_bytes(tiff[4:8], order)
    for i in range(int.from_bytes(tiff[at : at + 2], order)):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        if int.from_bytes(entry[:2], order) == 0x0112:
            return int.from_bytes(entry[8:10], order)
    return 1


def encode_png(pixels: np.ndarray) -> bytes:
    """Rows x columns x 1 to 4 channels of uint8."""
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes | None) -> np.ndarray | None:
    """Pixels of an 8-bit PNG without interlacing (palettes resolved, with alpha where tRNS has it), or None."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, alpha, head = 8, b"", None, None, None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            if len(part) < size:
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alpha = np.frombuffer(part, np.uint8)
            elif kind == b"IDAT":
                body += part
            at += 12 + size
        w, h, depth, colour, _, _, interlace = head
        if depth != 8 or interlace:
            return None
        c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * c + 1)
    except (zlib.error, struct.error, ValueError, KeyError, TypeError):
        return None
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        line = rows[y, 1:].astype(np.int64)
        kind = rows[y, 0]
        if kind == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(w * c):
                left = line[x - c] if x >= c else 0
                if kind == 3:
                    line[x] = (line[x] + (left + above[x]) // 2) & 255
                else:
                    corner = above[x - c] if x >= c else 0
                    p = left + above[x] - corner
                    near = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                    line[x] = (line[x] + near) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(h, w, c)
    if colour == 3:
        if palette is None:
            return None
        index = pixels[..., 0]
        pixels = palette[np.minimum(index, len(palette) - 1)]
        if alpha is not None:
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            pixels = np.concatenate([pixels, full[index][..., None]], axis=2)
    return pixels


def grey(pixels: np.ndarray) -> np.ndarray:
    colour = pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
    return colour @ np.array([0.299, 0.587, 0.114])


def resized(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means of a grey plane: exact weights of the cells that each target pixel covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        cells = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], cells + 1) - np.maximum(edge[:-1, None], cells), 0, None) * m / n

    return weights(plane.shape[0], h) @ plane @ weights(plane.shape[1], w).T


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits (signed): whether each of 8 x 9 grey cells is darker than its right neighbour."""
    small = np.rint(resized(grey(pixels), 8, 9))
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


def transparent_share(pixels: np.ndarray, below: int = 128) -> float:
    """Share of pixels whose alpha is below a limit; 0 without alpha."""
    return float((pixels[..., -1] < below).mean()) if pixels.shape[2] in (2, 4) else 0.0


def stitched(images: list[np.ndarray]) -> np.ndarray:
    """Four images of one size as a square of two by two."""
    return np.concatenate([np.concatenate(images[:2], axis=1), np.concatenate(images[2:4], axis=1)], axis=0)


def quadrants(pixels: np.ndarray) -> list[np.ndarray]:
    h, w = pixels.shape[0] // 2, pixels.shape[1] // 2
    return [pixels[y : y + h, x : x + w] for y in (0, h) for x in (0, w)]


def region_mask(regions: list[tuple[float, float, float, float, float]], width: int, height: int, cell: int = 8) -> np.ndarray:
    """Cell means of the largest weight over each pixel, for boxes (weight, x0, y0, x1, y1) with inclusive ends."""
    mask = np.zeros((height, width), np.float32)
    for weight, x0, y0, x1, y1 in regions:
        part = mask[max(0, int(y0)) : int(y1) + 1, max(0, int(x0)) : int(x1) + 1]
        np.maximum(part, weight, out=part)
    return mask[: height // cell * cell, : width // cell * cell].reshape(height // cell, cell, width // cell, cell).mean(axis=(1, 3))


def polygon_mask(regions: list[tuple[float, list[tuple[float, float]]]], width: int, height: int, cell: int = 8) -> np.ndarray:
    """Cell means of the largest weight over each pixel, for polygons (weight, points); a polygon holds its own outline.

    A pixel is inside where a ray to the right crosses the outline an odd number of times.
    """
    mask = np.zeros((height, width), np.float32)
    for weight, points in regions:
        p = np.asarray(points, float)
        q = np.roll(p, -1, axis=0)
        top, bottom = max(0, int(np.floor(p[:, 1].min()))), min(height - 1, int(np.ceil(p[:, 1].max())))
        inside = np.zeros((height, width), bool)
        for y in range(top, bottom + 1):
            crossed = (p[:, 1] <= y) != (q[:, 1] <= y)
            a, b = p[crossed], q[crossed]
            xs = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
            for left, right in zip(xs[::2], xs[1::2], strict=False):
                inside[y, max(0, int(np.ceil(left))) : int(np.floor(right)) + 1] = True
        for a, b in zip(p, q, strict=True):
            line = np.rint(a + (b - a) * np.linspace(0, 1, int(np.ceil(np.abs(b - a).max())) + 1)[:, None]).astype(int)
            line = line[(line >= 0).all(1) & (line[:, 0] < width) & (line[:, 1] < height)]
            inside[line[:, 1], line[:, 0]] = True
        mask[inside] = np.maximum(mask[inside], weight)
    return mask[: height // cell * cell, : width // cell * cell].reshape(height // cell, cell, width // cell, cell).mean(axis=(1, 3))


def image_facts(data: Column) -> Column:
    """struct<format, width, height, orientation, decoded, transparent, dhash> of image bytes."""

    @F.pandas_udf("format string, width int, height int, orientation int, decoded boolean, transparent double, dhash long")
    def facts(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            head, pixels = header(v), read_png(v)
            if head is None:
                rows.append((None, None, None, None, False, None, None))
            elif pixels is None:
                rows.append((*head, False, 0.0 if head[0] == "jpeg" else None, None))
            else:
                rows.append((*head, True, transparent_share(pixels), difference_hash(pixels)))
        return pd.DataFrame(rows, columns=["format", "width", "height", "orientation", "decoded", "transparent", "dhash"]).astype({"width": "Int32", "height": "Int32", "orientation": "Int32", "dhash": "Int64"})

    return facts(data)


def png_values(channels: int) -> Callable[[Column], Column]:
    """PNG bytes to a flat array of channel values, or null."""

    @F.pandas_udf("array<int>")
    def values(data: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> list[int] | None:
            pixels = read_png(v)
            if pixels is None:
                return None
            if pixels.shape[2] < channels:
                pixels = np.repeat(pixels[..., :1], channels, axis=2)
            return pixels[..., :channels].reshape(-1).astype(int).tolist()

        return data.map(one)

    return values
