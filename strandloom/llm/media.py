"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, and
written as NPY tiles with difference hashes.

Edge cases. A null image or one that is none of the known formats decodes to ``None`` and yields a
row with null shape, hash and tiles; so does a damaged file (cut off, a size field that lies, samples
that are no numbers or above the stated maximum). An image without pixels is not valid. A null text is the empty
text; the empty text is one row of 64 zero bytes. Equal inputs give equal rows; nothing depends on
the order of rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_lists

WIDTH = 64
TILE = 32
HASH_ROWS, HASH_COLUMNS = 8, 9

_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)*")
_MAXIMUM = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


# -- Netpbm ------------------------------------------------------------------------------------


def encode_pgm(image: np.ndarray) -> bytes:
    """A binary greyscale (8 or 16 bits) or colour (8 bits) Netpbm file."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    top = 65535 if image.dtype == np.uint16 else 255
    body = image.astype(">u2").tobytes() if top > 255 else np.ascontiguousarray(image, np.uint8).tobytes()
    return b"%s\n%d %d\n%d\n" % (kind, image.shape[1], image.shape[0], top) + body


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """P1 to P6; bitmaps come back as 0 (black) and 255, wide samples as uint16."""
    head = _HEADER.match(data)
    if not head:
        return None
    kind, width, height, at = int(head[1]), int(head[2]), int(head[3]), head.end()
    channels = 3 if kind in (3, 6) else 1
    top = 1
    if kind not in (1, 4):
        found = _MAXIMUM.match(data, at - 1 if data[at - 1 : at].isspace() else at)
        if not found:
            return None
        top, at = int(found[1]), found.end()
    elif kind == 4:
        at = head.end(3)
    count = width * height * channels
    if not count or not 0 < top < 65536:
        return None
    if kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if raw.size < stride * height:
            return None
        bits = np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if kind in (5, 6):
        wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(data) - at - 1 < count * wide.itemsize:
            return None
        flat = np.frombuffer(data, wide, count, at + 1)
        if flat.max() > top:
            return None
    else:
        plain = re.sub(rb"#[^\n]*", b"", data[head.end(3) if kind == 1 else at :])
        words = [c for c in plain if c in b"01"] if kind == 1 else plain.split()
        if len(words) < count:
            return None
        flat = np.array([x - 48 for x in words[:count]] if kind == 1 else [int(x) for x in words[:count]])
        if kind == 1:
            flat = 255 * (1 - flat)
        elif flat.min() < 0 or flat.max() > top:
            return None
    image = flat.reshape((height, width, 3) if channels == 3 else (height, width))
    return image.astype(np.uint16 if top > 255 else np.uint8)


# -- BMP ---------------------------------------------------------------------------------------


def encode_bmp(image: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette, or 24 bits for colour."""
    height, width = image.shape[:2]
    depth = 24 if image.ndim == 3 else 8
    palette = b"" if depth == 24 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * depth // 8] = (image[:, :, ::-1] if depth == 24 else image).reshape(height, -1)
    body = rows[::-1].tobytes()
    start = 54 + len(palette)
    return (
        struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
        + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, len(body), 2835, 2835, len(palette) // 4, 0)
        + palette
        + body
    )


def decode_bmp(data: bytes) -> np.ndarray | None:
    """Uncompressed 1, 4, 8, 24 and 32 bits, bottom-up or top-down; grey palettes give one channel."""
    if len(data) < 54 or data[:2] != b"BM":
        return None
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    tall = abs(height)
    if packed or width <= 0 or not tall or depth not in (1, 4, 8, 24, 32):
        return None
    stride = (width * depth + 31) // 32 * 4
    if len(data) < start + stride * tall:
        return None
    rows = np.frombuffer(data, np.uint8, stride * tall, start).reshape(tall, stride)
    rows = rows[::-1] if height > 0 else rows
    if depth >= 24:
        step = depth // 8
        return np.ascontiguousarray(rows[:, : width * step].reshape(tall, width, step)[:, :, 2::-1])
    if depth == 8:
        index = rows[:, :width]
    elif depth == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(tall, -1)[:, :width]
    else:
        index = np.unpackbits(rows, axis=1)[:, :width]
    at = 14 + size
    entries = max(0, min(1 << depth, (start - at) // 4))
    table = np.zeros((256, 3), np.uint8)
    table[:entries] = np.frombuffer(data, np.uint8, entries * 4, at).reshape(-1, 4)[:, 2::-1]
    colours = table[index]
    grey = (table[:, 0] == table[:, 1]) & (table[:, 1] == table[:, 2])
    return np.ascontiguousarray(colours[:, :, 0] if grey.all() else colours)


def decode(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, OverflowError):  # numpy's and Python's for samples and sizes that can't be
        return None


# -- Features ----------------------------------------------------------------------------------


def grey(image: np.ndarray) -> np.ndarray:
    """One float channel; colour by the BT.601 weights."""
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal rectangles with fractional edges, from one integral image.

    The integral of the picture up to a fractional point is bilinear between its four integer
    neighbours, so every output pixel needs four look-ups however large its rectangle is.
    """
    height, width = image.shape
    total = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])

    def along(values: np.ndarray, size: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * (size / parts)
        low = np.minimum(at.astype(np.int64), size)
        part = (at - low)[:, None]
        return values[low] * (1 - part) + values[np.minimum(low + 1, size)] * part

    corner = along(along(total, height, rows).T, width, columns).T
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums / (height / rows * (width / columns))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: is a cell of the 8 x 9 reduction darker than its right neighbour?"""
    small = area_resize(grey(image), HASH_ROWS, HASH_COLUMNS)
    bits = small[:, 1:] - small[:, :-1] > 1e-9
    return np.packbits(bits).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, size: int = TILE) -> list[tuple[int, int, bytes]]:
    """The whole image as NPY tiles of ``size`` x ``size``, those at the right and bottom smaller."""
    return [
        (y // size, x // size, npy(image[y : y + size, x : x + size]))
        for y in range(0, image.shape[0], size)
        for x in range(0, image.shape[1], size)
    ]


def untile(parts: list[tuple[int, int, bytes]]) -> np.ndarray:
    grid: dict[int, dict[int, np.ndarray]] = {}
    for y, x, data in parts:
        grid.setdefault(y, {})[x] = np.load(io.BytesIO(data), allow_pickle=False)
    return np.concatenate([np.concatenate([row[x] for x in sorted(row)], axis=1) for _, row in sorted(grid.items())])


# -- DataFrame operators -----------------------------------------------------------------------


def media_features(images: DataFrame, key: str, column: str) -> DataFrame:
    """key, height, width, channels and difference hash of each image of a binary column."""

    def make():
        def each(data):
            found = [decode(x) for x in data]
            there = [x is not None for x in found]
            return [
                [*range(len(found))],
                [x.shape[0] if ok else None for x, ok in zip(found, there, strict=True)],
                [x.shape[1] if ok else None for x, ok in zip(found, there, strict=True)],
                [(x.shape[2] if x.ndim == 3 else 1) if ok else None for x, ok in zip(found, there, strict=True)],
                [difference_hash(x) if ok else None for x, ok in zip(found, there, strict=True)],
            ]

        return each

    return map_lists(images.select(key, column), make, {"height": "int", "width": "int", "channels": "int", "dhash": "string"}, keep=key)


def media_tiles(images: DataFrame, key: str, column: str, size: int = TILE, shape: tuple[int, int] | None = None) -> DataFrame:
    """One row per NPY tile (key, tile_row, tile_column, npy); ``shape`` resizes the image first."""

    def make():
        def each(data):
            rows = []
            for i, x in enumerate(data):
                image = decode(x)
                if image is not None:
                    if shape:
                        image = np.rint(area_resize(grey(image), *shape)).astype(np.uint8)
                    rows += [(i, *part) for part in tiles(image, size)]
            return [list(x) for x in zip(*rows, strict=True)] or [[], [], [], []]

        return each

    return map_lists(images.select(key, column), make, {"tile_row": "int", "tile_column": "int", "npy": "binary"}, keep=key)


def text_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def text_media(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each whole text as a greyscale PGM of 64 columns: key, n_bytes, media.

    Rows: one per input row. Null text: as the empty text. Nothing is cut.
    """

    def make():
        def each(texts):
            made = [text_payload(x) for x in texts]
            return [[*range(len(made))], [n for n, _ in made], [encode_pgm(np.frombuffer(x, np.uint8).reshape(-1, WIDTH)) for _, x in made]]

        return each

    return map_lists(documents.select(key, column), make, {"n_bytes": "long", "media": "binary"}, keep=key)


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored media, from the bytes read back out of the stored form.

    ``feature`` is the difference hash of the decoded image followed by its mean grey level and
    shape; ``n_tiles`` and ``tiles_sha256`` describe its NPY tiles.
    """
    schema = {
        "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
        "media_sha256": "string", "feature": "string", "n_tiles": "int", "tiles_sha256": "string", "n_bytes": "long",
    }

    def make():
        def each(sizes, stored):
            rows = []
            for i, (n, data) in enumerate(zip(sizes, stored, strict=True)):
                image = decode(data)
                back = image.tobytes()
                parts = tiles(image)
                seal = hashlib.sha256()
                for _, _, part in parts:
                    seal.update(part)
                feature = f"dhash:{difference_hash(image)};mean:{image.mean():.6f};shape:{image.shape[0]}x{image.shape[1]}"
                rows.append((i, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(parts), seal.hexdigest(), n))
            return [list(x) for x in zip(*rows, strict=True)]

        return each

    return map_lists(media.select(key, "n_bytes", "media"), make, schema, keep=key)


def text_features(documents: DataFrame) -> DataFrame:
    """Stores every text as an image and describes it by what is read back; see the parts."""
    return media_digest(text_media(documents))
