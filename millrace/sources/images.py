"""Image files as thumbnails of pixels: the source of the image signals."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longer side of a thumbnail, bytes of a file at most.
SIDE, MOST_BYTES = 64, 8 << 20
PIXELS = "image_id string, width int, height int, x int, y int, r int, g int, b int"


def _png(data: bytes) -> np.ndarray | None:
    """Pixels of a PNG with 8 bits a channel, not interlaced; transparent ones lie on white."""
    at, head, body, palette = 8, None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if head is None or head[2] != 8 or head[6] or head[0] * head[1] > 64 << 20:
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    step = width * channels
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, step + 1)
    out = np.zeros((height, step), np.uint8)
    above = np.zeros(step, np.int32)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            row = (row + above) & 255
        elif kind:
            for i in range(step):
                left = row[i - channels] if i >= channels else 0
                corner = above[i - channels] if i >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + guess) & 255
        out[y], above = row, row
    px = out.reshape(height, width, channels)
    if head[3] == 3:
        return palette[px[:, :, 0]]
    colour = px[:, :, :3] if channels >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    if channels in (2, 4):
        alpha = px[:, :, -1:].astype(float) / 255
        colour = np.rint(colour * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return colour


def _ppm(data: bytes) -> np.ndarray | None:
    parts = data.split(maxsplit=4)
    if len(parts) < 5 or parts[3] != b"255":
        return None
    width, height = int(parts[1]), int(parts[2])
    return np.frombuffer(data[-3 * width * height :], np.uint8).reshape(height, width, 3)


def decode(data: bytes) -> np.ndarray | None:
    """Pixels of a PNG or PPM file; None where it is none, is damaged or too large."""
    if len(data) > MOST_BYTES:
        return None
    try:
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _ppm(data) if data[:2] == b"P6" else None
    except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error):
        return None


def thumbnail(px: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The nearest pixel of each place of a picture whose longer side is ``side`` at most."""
    height, width = px.shape[:2]
    scale = max(height, width) / side
    if scale <= 1:
        return px
    h, w = max(1, round(height / scale)), max(1, round(width / scale))
    return px[(np.arange(h) * height // h)[:, None], (np.arange(w) * width // w)[None, :]]


def pixels(files: DataFrame) -> DataFrame:
    """Thumbnail pixels of image files (image_id, content); unreadable ones give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["image_id"], b["content"]):
                px = None if data is None else decode(bytes(data))
                if px is None:
                    continue
                px = thumbnail(px)
                h, w = px.shape[:2]
                y, x = np.divmod(np.arange(h * w), w)
                flat = px.reshape(-1, 3)
                yield pd.DataFrame({"image_id": name, "width": w, "height": h, "x": x, "y": y, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.mapInPandas(run, PIXELS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Thumbnail pixels of the image files under a path; too large ones are left out before they are read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES)
    return pixels(files.select(F.col("path").alias("image_id"), "content"))
