"""A window reader for GeoTIFF: one band, strips or tiles, any byte order.

Uncompressed, LZW, deflate, PackBits and Zstandard (where ``zstandard`` is installed), with predictors 2 and 3.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

# TIFF tags and field types that are read here.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PROJECTED_CRS = 3072


class GeoTiff:
    """One band, sliced like a 2-D array and read only where it is sliced; safe to pickle, since no file stays open."""

    ndim = 2

    def __init__(self, path: str | Path, band: int = 1):
        self.path = str(path)
        with open(self.path, "rb") as f:
            order = {b"II": "<", b"MM": ">"}.get(f.read(2))
            if order is None:
                raise ValueError(f"{path} is not a TIFF")
            self.order = order
            self.big = struct.unpack(order + "H", f.read(2))[0] == 43
            self.tags = self._directory(f)
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.count = one(SAMPLES, 1)
        if not 1 <= band <= self.count:
            raise ValueError(f"{path} has {self.count} band(s); band {band} asked for")
        self.band, self.shape = band, (one(HEIGHT), one(WIDTH))
        self.dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 8) // 8}")
        self.apart = one(PLANAR, 1) == 2
        self.compression, self.predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if self.compression not in (1, *CODECS) or self.predictor not in (1, 2, 3) or self.predictor == 3 and self.dtype.kind != "f":
            raise ValueError(f"{path}: compression {self.compression} with predictor {self.predictor} is not supported")
        self.tiled = TILE_WIDTH in self.tags
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if self.tiled else (min(one(ROWS_PER_STRIP, self.shape[0]), self.shape[0]), self.shape[1])
        text = self.tags.get(NODATA, (b"",))[0].rstrip(b"\0 ")
        self.nodata = float(text) if text else None

    def _directory(self, f) -> dict:
        if self.big:
            f.seek(8)
        (at,) = struct.unpack(self.order + ("Q" if self.big else "I"), f.read(8 if self.big else 4))
        f.seek(at)
        (n,) = struct.unpack(self.order + ("Q" if self.big else "H"), f.read(8 if self.big else 2))
        size, room = (20, 8) if self.big else (12, 4)
        raw, tags = f.read(n * size), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), raw, i * size)
            if kind not in KINDS:
                continue
            form = f"{self.order}{count}{KINDS[kind]}" if len(KINDS[kind]) == 1 else f"{self.order}{2 * count}I"
            need = struct.calcsize(form)
            data = raw[i * size + size - room :][:need]
            if need > room:
                f.seek(struct.unpack(self.order + ("Q" if self.big else "I"), raw[(i + 1) * size - room : (i + 1) * size])[0])
                data = f.read(need)
            tags[tag] = struct.unpack(form, data)
        return tags

    @property
    def transform(self) -> tuple | None:
        """(a, b, c, d, e, f) of the file, or None."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return (m[0], m[1], m[3], m[4], m[5], m[7])
        if PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            sx, sy, _ = self.tags[PIXEL_SCALE]
            i, j, _, x, y, _ = self.tags[TIE_POINT][:6]
            return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        return None

    @property
    def crs(self) -> str | None:
        keys = self.tags.get(GEO_KEYS, ())
        for i in range(4, len(keys), 4):
            if keys[i] == PROJECTED_CRS and keys[i + 1] == 0:
                return f"EPSG:{keys[i + 3]}"
        return None

    def __getitem__(self, key) -> np.ndarray:
        """The pixels of ``image[top:bottom, left:right]``, read from the blocks that hold them."""
        spans = []
        for cut, size in zip(key if isinstance(key, tuple) else (key,), self.shape):
            if not isinstance(cut, slice):
                raise TypeError(f"an image is read by a range of rows and one of columns, not by {cut!r}")
            spans.append(range(*cut.indices(size)))
        if len(spans) != 2 or len(key) != 2:
            raise TypeError("an image is read by a range of rows and one of columns")
        if {s.step for s in spans} != {1}:
            raise ValueError("rows and columns are read one after the other: steps are not supported")
        rows, cols = spans
        out = np.zeros((len(rows), len(cols)), self.dtype.newbyteorder("="))
        if not out.size:
            return out
        per_row, per_col = (-(-n // size) for n, size in zip(self.shape[::-1], self.block[::-1]))
        first = (self.band - 1) * per_row * per_col if self.apart else 0
        with open(self.path, "rb") as f:
            for i in range(rows.start // self.block[0], -(-rows.stop // self.block[0])):
                for j in range(cols.start // self.block[1], -(-cols.stop // self.block[1])):
                    block = self._block(f, first + i * per_row + j)
                    y, x = i * self.block[0] - rows.start, j * self.block[1] - cols.start  # the block's corner in ``out``
                    here = block[max(-y, 0) : len(rows) - y, max(-x, 0) : len(cols) - x]
                    out[max(y, 0) : max(y, 0) + here.shape[0], max(x, 0) : max(x, 0) + here.shape[1]] = here
        return clean(out, self.nodata)

    def _block(self, f, n: int) -> np.ndarray:
        offsets, sizes = (TILE_OFFSETS, TILE_BYTES) if self.tiled else (STRIP_OFFSETS, STRIP_BYTES)
        f.seek(self.tags[offsets][n])
        data = f.read(self.tags[sizes][n])
        if self.compression != 1:
            data = CODECS[self.compression](data)
        per = 1 if self.apart else self.count
        rows = len(data) // (self.block[1] * per * self.dtype.itemsize)
        if self.predictor == 3:
            data = joined_planes(np.frombuffer(data, np.uint8)[: rows * self.block[1] * per * self.dtype.itemsize], rows, per, self.dtype)
        block = np.frombuffer(data, self.dtype)[: rows * self.block[1] * per].reshape(rows, self.block[1], per)
        if self.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=self.dtype)
        return block[:, :, 0 if self.apart else self.band - 1]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        whole = self[:, :]
        return whole if dtype is None else whole.astype(dtype)


def joined_planes(data: np.ndarray, rows: int, per: int, dtype: np.dtype) -> bytes:
    """Rows of floats that were stored as differences of their bytes, the highest byte of all samples first."""
    steps = data.reshape(rows, -1, per)
    planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
    return planes.transpose(0, 2, 1).copy().view(dtype.newbyteorder(">")).astype(dtype).tobytes()


# Fixed values of TIFF's LZW: the code that empties the table, the code that ends the data, the narrowest and widest codes.
LZW_CLEAR, LZW_END, LZW_NARROW, LZW_WIDE = 256, 257, 9, 12


def unpack_lzw(data: bytes) -> bytes:
    """Codes of growing width, the highest bit first; a width grows one code before its range is used up."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, out = list(single), None, bytearray()
    width, held, bits = LZW_NARROW, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, last, width = list(single), None, LZW_NARROW
            continue
        if last is not None:
            if code > len(table):
                raise ValueError("the LZW data holds a code that is not known yet")
            table.append(last + (table[code] if code < len(table) else last)[:1])
        last = table[code]
        out += last
        width = min(max(LZW_NARROW, (len(table) + 1).bit_length()), LZW_WIDE)
    return bytes(out)


def unpack_zstd(data: bytes) -> bytes:
    try:
        import zstandard
    except ImportError:
        raise ValueError("this file is compressed with Zstandard: install zstandard") from None
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


#: The compressions that are read here, by their number in TIFF.
CODECS = {5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits, 50000: unpack_zstd}


def clean(data: np.ndarray, nodata: float | None) -> np.ndarray:
    """No-data and non-finite pixels as 0."""
    void = np.zeros(data.shape, bool) if data.dtype.kind != "f" else ~np.isfinite(data)
    if nodata is not None:
        void |= data == nodata  # a no-data value of NaN equals nothing, but is not finite
    return np.where(void, data.dtype.type(0), data)
