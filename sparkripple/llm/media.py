"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

decode() reads P5, P6, P2, P3 Netpbm and uncompressed 8- and 24-bit BMP.
area_resize() averages over areas by an integral image, made in strips of rows
so that its memory is bounded however high the image is. npy_tiles() stores an
array as NPY tiles of bounded height, read back by read_tiles().

text_media() carries every document's text through that way: the UTF-8 bytes,
filled with zero bytes to a multiple of 64, become a greyscale Netpbm image of
64 columns, are decoded, stored as NPY tiles, read back and described by a
difference hash. Null texts count as empty; the smallest payload is one row of
64 zero bytes. Everything is per row, so ties, repeated rows and extra columns
change nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import carried, restored

COLUMNS = 64
TILE_ROWS = 4096
#: Numbers of the integral image that are in memory at a time.
STRIP_CELLS = 1 << 18
SCHEMA = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long"


def decode(data: bytes) -> np.ndarray:
    """Image bytes to an array of rows x columns, or rows x columns x 3 in red, green, blue order."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        image = decode_netpbm(data)
    elif data[:2] == b"BM":
        image = decode_bmp(data)
    else:
        raise ValueError("neither Netpbm nor BMP")
    if not image.size:
        raise ValueError("no samples")
    return image


def decode_netpbm(data: bytes) -> np.ndarray:
    header = re.match(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not header:
        raise ValueError("no Netpbm header")
    kind, width, height, top = (int(x) for x in header.groups())
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind in (2, 3):
        samples = np.array(data[header.end() :].split()[:n], dtype=np.int64)
    else:
        samples = np.frombuffer(data, dtype=np.uint8 if top < 256 else ">u2", count=n, offset=header.end())
    return samples.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    at = struct.unpack_from("<I", data, 10)[0]
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    colours = np.frombuffer(data, dtype=np.uint8, offset=14 + head, count=at - 14 - head).reshape(-1, 4)[:, 2::-1]
    return colours[rows[:, :width]]


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def placed(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n + 1 edges of equal parts of a length, as the place before each and the part of it beyond."""
    edges = np.linspace(0, size, n + 1)
    low = np.minimum(edges.astype(int), size - 1)
    return low, edges - low


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over equal areas of the grey image, in parts of pixels where edges cut them, from its integral image.

    Of the integral only the rows beside the areas' edges are kept; the others pass by in strips.
    """
    height, width = image.shape[:2]
    low, part = placed(rows, height)
    needed = np.union1d(low, low + 1)
    kept = np.zeros((len(needed), width + 1))
    above = np.zeros(width + 1)
    strip = max(1, STRIP_CELLS // (width + 1))
    for top in range(0, height, strip):
        block = grey(image[top : top + strip])
        integral = np.empty((len(block) + 1, width + 1))
        integral[0], integral[1:, 0] = above, 0
        np.cumsum(np.cumsum(block, axis=1, dtype=np.float64), axis=0, out=integral[1:, 1:])
        integral[1:] += above
        at = np.flatnonzero((needed >= top) & (needed <= top + len(block)))
        kept[at] = integral[needed[at] - top]
        above = integral[-1].copy()
    spot = np.searchsorted(needed, low)
    table = kept[spot] * (1 - part)[:, None] + kept[spot + 1] * part[:, None]
    low, part = placed(columns, width)
    table = table[:, low] * (1 - part) + table[:, low + 1] * part
    areas = np.diff(np.diff(table, axis=0), axis=1)
    return areas / (height / rows * width / columns)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 area mean is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    tiles = []
    for top in range(0, len(image), rows):
        np.save(tile := io.BytesIO(), np.ascontiguousarray(image[top : top + rows]), allow_pickle=False)
        tiles.append(tile.getvalue())
    return tiles


def read_tiles(tiles: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(tile), allow_pickle=False) for tile in tiles])


def media_row(text: str) -> tuple:
    raw = text.encode()
    payload = raw + bytes(-len(raw) % COLUMNS if raw else COLUMNS)
    image = decode(b"P5\n%d %d\n255\n" % (COLUMNS, len(payload) // COLUMNS) + payload)
    tiles = npy_tiles(image)
    back = read_tiles(tiles)
    stored, read = b"".join(tiles), back.tobytes()
    return len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-COLUMNS:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(back), len(tiles)


def text_media(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(doc_id, *media_row(text)) for doc_id, text in zip(batch["doc_id"], batch["text"])], columns=names)

    own = docs.select(carried(), F.coalesce("text", F.lit("")).alias("text"))
    return restored(own.mapInPandas(run, SCHEMA))


def resize_images(images: DataFrame, rows: int, columns: int) -> DataFrame:
    """(id, data binary) to (id, height, width, tile binary, hash): decoded, area-resized, stored as one NPY of all rows.

    Samples keep the width of the image's own, so those of 16 bits stay unscaled. Null or unreadable data gives nulls in all columns but id.
    """
    schema = "id string, height long, width long, tile binary, hash string"

    def one(data) -> tuple:
        try:
            image = decode(bytes(data))
        except (ValueError, TypeError, struct.error):
            return (None, None, None, None)
        return (*image.shape[:2], npy_tiles(np.round(area_resize(image, rows, columns)).astype(image.dtype), rows)[0], difference_hash(image))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *one(data)) for i, data in zip(batch["id"], batch["data"])], columns=["id", "height", "width", "tile", "hash"]).astype({"height": "Int64", "width": "Int64"})

    return restored(images.select(carried("id"), "data").mapInPandas(run, schema), "id")
