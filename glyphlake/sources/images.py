"""Pixels of image files (S16 to F6, F7): PNG, PNM and BMP are decoded in numpy, other formats by OpenCV where it is installed."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "image_id long, y int, x int, c0 int, c1 int, c2 int"


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """PNG's rows (a filter's number, then bytes) as bytes. Each filter adds what stands to the left, above, or both."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            line, up = line.astype(int), above.astype(int)
            for x in range(len(line)):
                left = line[x - step] if x >= step else 0
                corner = up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    near = {left: abs(up[x] - corner), up[x]: abs(left - corner), corner: abs(left + up[x] - 2 * corner)}
                    least = min(near.values())
                    guess = next(v for v in (left, up[x], corner) if near[v] == least)
                line[x] = (line[x] + guess) % 256
            line = line.astype(np.uint8)
        elif kind:
            raise ValueError("unknown filter")
        out[y] = above = line
    return out


def _png(data: bytes) -> np.ndarray:
    at, parts, palette = 8, [], None
    width = height = depth = colour = interlaced = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if interlaced or depth not in (1, 2, 4, 8, 16):
        raise ValueError("interlaced images are not read here")
    line = (width * channels * depth + 7) // 8
    raw = _unfilter(np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, line + 1), max(1, channels * depth // 8))
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1)[:, : width * depth].reshape(height, width, depth)
        raw = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        raw = raw if colour == 3 else raw * (255 // ((1 << depth) - 1))
    pixels = raw.reshape(height, width, channels)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if channels >= 3 else pixels[:, :, :1]


def _pnm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])(?:\s+(?:#[^\n]*\n\s*)*(\d+))(?:\s+(?:#[^\n]*\n\s*)*(\d+))(?:\s+(?:#[^\n]*\n\s*)*(\d+))\s", data)
    if not head or int(head[4]) > 255:
        raise ValueError("not a binary map of 8 bits")
    channels, width, height = 3 if head[1] == b"6" else 1, int(head[2]), int(head[3])
    return np.frombuffer(data, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if depth not in (24, 32) or packed:
        raise ValueError("not a plain bitmap of 24 or 32 bits")
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    return (rows[::-1] if height > 0 else rows)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3) of red, green and blue, or of grey; a format that can't be read raises ValueError."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (KeyError, IndexError, struct.error, zlib.error, TypeError) as e:
        raise ValueError("damaged image") from e
    try:
        import cv2
    except ImportError as e:
        raise ValueError("this format needs OpenCV") from e
    found = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR) if data else None
    if found is None:
        raise ValueError("damaged image")
    return found[:, :, ::-1]


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, c0, c1, c2), a row per pixel of (image_id, content); grey is in all three. Images that can't be read have none.

    Rows leave a task in batches of one line of pixels or more, so a large image is never whole in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "y", "x", "c0", "c1", "c2"]
        for batch in batches:
            for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    found = decode(content.as_py() or b"")
                except ValueError:
                    continue
                height, width, channels = found.shape
                step = max(1, (1 << 16) // max(1, width))
                for y in range(0, height, step):
                    part = found[y : y + step].reshape(-1, channels).astype(np.int32)
                    at = np.arange(len(part))
                    columns = [np.full(len(part), image, np.int64), (y + at // width).astype(np.int32), (at % width).astype(np.int32), *[part[:, k if channels > 1 else 0] for k in range(3)]]
                    yield pa.record_batch([pa.array(c) for c in columns], names)

    return images.where("image_id is not null").select("image_id", "content").mapInArrow(run, SCHEMA)
