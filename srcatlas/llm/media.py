"""Media columns: Netpbm and BMP samples, area resizing and NPY tiles.

``decode`` reads binary and plain Netpbm (P1 to P6) and uncompressed BMP
(8, 24 and 32 bits) to numpy arrays; ``area_resize`` averages exact areas
with integral images; ``difference_hash`` and ``npy_tile`` give the perceptual
hash and the stored tile.  ``text_media`` keeps a text as an 8-bit image: its
UTF-8 bytes, padded with zeros to a multiple of 64, are the samples of a grey
image 64 wide.  The low bit of the payload's crc32 picks PGM or BMP, so equal
texts give equal values and both decoders carry the corpus.

Cases: a null text is an empty one, an empty payload is 64 zero bytes; very
long texts make tall images, one in memory at a time, resized a few rows at a
time; repeated rows give equal rows; an empty table gives no rows; only
``doc_id`` and ``text`` are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_or_empty

WIDTH = 64
TILE = 32
#: Image rows summed at once.
ROWS = 4096
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, format string, tile_npy binary"
)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8 bits a pixel with a grey palette, rows bottom up and padded to 4 bytes."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    grey = np.zeros((256, 4), np.uint8)
    grey[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    start = 14 + 40 + grey.nbytes
    head = struct.pack("<2sIHHI", b"BM", start + rows.nbytes, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.nbytes, 2835, 2835, 256, 256)
    return head + info + grey.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 samples; ValueError for anything else."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    values, at = [], 2
    while len(values) < fields:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        values.append(int(data[at:end]))
        at = end
    return values, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    values, at = _header(data, 2 if bitmap else 3)
    width, height = values[:2]
    top = 1 if bitmap else values[2]
    if not (width and height and 0 < top < 65536):
        raise ValueError("bad Netpbm size")
    count = width * height * channels
    if kind == 1:
        digits = np.frombuffer(data[at - 1 :], np.uint8)
        samples = digits[(digits == 48) | (digits == 49)][:count] - 48
    elif kind == 4:
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        samples = np.unpackbits(packed, axis=1)[:, :width].ravel()
    elif kind in (2, 3):
        samples = np.array(data[at - 1 :].split()[:count], dtype=np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else np.dtype(">u2"), count, at)
    if samples.size != count:
        raise ValueError("truncated Netpbm")
    if bitmap:
        samples = (1 - samples) * np.uint8(255)
    elif top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    shape = (height, width, 3) if channels == 3 else (height, width)
    return samples.astype(np.uint8, copy=False).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    used = struct.unpack_from("<I", data, 46)[0]
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    rows, step = abs(height), bits // 8
    stride = (width * step + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    body = body[:, : width * step]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
        ramp = np.arange(len(palette), dtype=np.uint8)
        if (palette == ramp[:, None]).all():
            return np.ascontiguousarray(body)
        return palette[body]
    return np.ascontiguousarray(body.reshape(rows, width, step)[:, :, 2::-1])


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, in float64, from an integral image.

    A cell's edges fall between samples; the integral image is interpolated
    there, which is exact for sums over fractions of samples.  The image is
    summed ``ROWS`` rows at a time and only the lines that cells need are kept,
    so a tall image takes no more memory than a small one.
    """
    rows, columns = samples.shape[:2]
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, columns, width + 1)
    at = np.minimum(y.astype(np.int64), rows - 1)
    part = y - at
    lines = np.zeros((height + 1, columns + 1))
    above = np.zeros(columns + 1)
    for low in range(0, rows, ROWS):
        block = samples[low : low + ROWS]
        grey = block if block.ndim == 2 else block.mean(axis=2)
        sums = np.zeros((grey.shape[0] + 1, columns + 1))
        np.cumsum(grey, axis=0, out=sums[1:, 1:], dtype=np.float64)
        np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
        sums += above
        here = np.flatnonzero((at >= low) & (at < low + grey.shape[0]))
        k = at[here] - low
        lines[here] = sums[k] * (1 - part[here, None]) + sums[k + 1] * part[here, None]
        above = sums[-1].copy()
    low = np.minimum(x.astype(np.int64), columns - 1)
    part = x - low
    corners = lines[:, low] * (1 - part) + lines[:, low + 1] * part
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / ((rows / height) * (columns / width))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits as hex: each cell of an 8 x 9 resize against its right neighbour."""
    cells = np.rint(area_resize(samples, 8, 9) * 256).astype(np.int64)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to a square uint8 tile, as the bytes of an NPY file."""
    tile = np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def media_of(text: bytes) -> tuple:
    """Stores the text, reads the stored bytes back, and describes what came back.

    At most four copies of the text exist at a time: it, its payload, the
    stored form and what is read back from that.
    """
    size = len(text)
    payload = text + bytes(-size % WIDTH or (0 if text else WIDTH))
    encode = encode_bmp if zlib.crc32(payload) & 1 else encode_pgm
    stored = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
    del payload
    back = np.ascontiguousarray(decode(stored))
    return (
        size, back.size, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-1]),
        len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(back), "bmp" if stored[:2] == b"BM" else "pgm", npy_tile(back),
    )


def text_media(docs: DataFrame) -> DataFrame:
    """One row of media facts per document, with its NPY tile."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            facts = [media_of(t.as_buffer().to_pybytes()) for t in batch.column(1).cast(pa.large_binary())]
            columns = list(zip(*facts, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *arrays],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "tile_npy"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def write_tiles(docs: DataFrame, path: str) -> None:
    """Writes doc_id, hash and NPY tile of every document."""
    text_media(docs).select("doc_id", "feature", "tile_npy").write.parquet(path)
