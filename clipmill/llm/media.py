"""Media columns: Netpbm and BMP images in binary columns.

Decoded to numpy arrays, resized by exact area means from integral images, cut
into NPY tiles, each with a difference hash.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
UNIT = 3 * WIDTH
BAND = 4096
SLICE = 256  # rows that leave a task at a time
TILE = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())]))
TILE_TYPE = "array<struct<row:int,col:int,npy:binary,dhash:string>>"
FACTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()),
            ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_tiles", T.LongType()), ("tiles_sha256", T.StringType()),
        )
    ]
)
TILE_ROWS = "height int, width int, channels int, error string, dhash string, tiles " + TILE_TYPE


class BadMedia(ValueError):
    pass


# --- formats ---------------------------------------------------------------------------------------


def encode_ppm(image: np.ndarray) -> bytes:
    """PGM (two axes) or PPM (three channels) with 8-bit samples."""
    kind = "P6" if image.ndim == 3 else "P5"
    return f"{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, bottom row first."""
    h, w = image.shape[:2]
    pad = -3 * w % 4
    rows = np.pad(image[::-1, :, ::-1].reshape(h, 3 * w), ((0, 0), (0, pad))).astype(np.uint8)
    info = np.array([40, w, h], "<i4").tobytes() + np.array([1, 24], "<i2").tobytes() + np.array([0, rows.size, 2835, 2835, 0, 0], "<i4").tobytes()
    return b"BM" + np.array([54 + rows.size, 0, 54], "<i4").tobytes() + info + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with comments; samples of over 8 bits come as uint16, bitmaps as 0 and 1."""
    kind = data[:2]
    count = 2 if kind in (b"P1", b"P4") else 3
    at, numbers = 2, []
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")
    for _ in range(count):
        m = token.match(data, at)
        if not m:
            raise BadMedia("header is cut off")
        numbers.append(int(m[1]))
        at = m.end()
    w, h = numbers[:2]
    top = numbers[2] if count == 3 else 1
    if not w or not h or not 0 < top < 65536:
        raise BadMedia("size or maximum is out of range")
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if channels == 3 else (h, w)
    n = h * w * channels
    if kind == b"P1":
        bits = re.findall(rb"[01]", re.sub(rb"#[^\n\r]*", b"", data[at:]))
        flat = np.array(bits[:n], dtype="S1").astype(np.uint8) if bits else np.zeros(0, np.uint8)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=object).astype(np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        line = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: h * line]
        if len(raw) < h * line:
            raise BadMedia("samples are cut off")
        flat = np.unpackbits(raw.reshape(h, line), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data[at + 1 : at + 1 + n * (2 if top > 255 else 1)], ">u2" if top > 255 else np.uint8)
    if len(flat) < n:
        raise BadMedia("samples are cut off")
    return flat.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits, either row order."""
    if len(data) < 54:
        raise BadMedia("header is cut off")
    start, head, w, h = np.frombuffer(data, "<i4", 4, 10).tolist()
    bits = int.from_bytes(data[28:30], "little")
    method, used = int.from_bytes(data[30:34], "little"), int.from_bytes(data[46:50], "little")
    down, h = h < 0, abs(h)
    if head < 40 or w <= 0 or not h or method not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise BadMedia("kind of BMP isn't supported")
    line = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data[start : start + h * line], np.uint8)
    if len(raw) < h * line:
        raise BadMedia("samples are cut off")
    rows = raw.reshape(h, line)
    if bits >= 24:
        image = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data[14 + head : 14 + head + 4 * (used or 1 << bits)], np.uint8).reshape(-1, 4)[:, 2::-1]
        index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(h, -1)
        if index[:, :w].max() >= len(palette):
            raise BadMedia("palette is too short")
        image = palette[index[:, :w]]
    return image if down else image[::-1]


def decode(data: bytes | None) -> np.ndarray:
    data = bytes(data or b"")
    if data[:2] == b"BM":
        return decode_bmp(data)
    if re.match(rb"P[1-6][\s#]", data):
        return decode_netpbm(data)
    raise BadMedia("neither Netpbm nor BMP")


# --- resizing, hashes, tiles -----------------------------------------------------------------------


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) area that each target pixel covers, from an integral image.

    The image is summed in bands of rows and only the rows of sums that the target
    needs are kept, so memory doesn't grow with the height of the image.
    """
    planes = image.reshape(*image.shape[:2], -1)
    h, w = planes.shape[:2]

    def edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.linspace(0, size, parts + 1)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    y, fy = edges(h, height)
    x, fx = edges(w, width)
    wanted = np.unique(np.concatenate([y, y + 1]))
    sums = np.zeros((len(wanted), w + 1, planes.shape[2]))
    carry = np.zeros((w, planes.shape[2]))
    for start in range(0, h, BAND):
        band = planes[start : start + BAND].astype(np.float64).cumsum(0) + carry
        here = np.flatnonzero((wanted > start) & (wanted <= start + len(band)))
        sums[here, 1:] = band[wanted[here] - start - 1]
        carry = band[-1]
    sums = sums.cumsum(1)
    y = np.searchsorted(wanted, y)
    rows = sums[y] * (1 - fy)[:, None, None] + sums[y + 1] * fy[:, None, None]
    grid = rows[:, x] * (1 - fx)[None, :, None] + rows[:, x + 1] * fx[None, :, None]
    total = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return (total / (h / height * w / width)).reshape(height, width, *image.shape[2:])


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def dhash(image: np.ndarray) -> str:
    """64 bits as hex: whether brightness rises to the right in an 8 x 9 reduction."""
    small = np.round(grey(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, size: int) -> list[tuple[int, int, bytes, str]]:
    """(row, column, NPY bytes, difference hash) of each tile; those at the edges may be smaller."""
    cuts = [(y, x) for y in range(0, image.shape[0], size) for x in range(0, image.shape[1], size)]
    return [(y // size, x // size, npy(t), dhash(t)) for y, x in cuts for t in [image[y : y + size, x : x + size]]]


def to_tiles(df: DataFrame, media_col: str = "media", height: int = 64, width: int = 64, tile: int = 32) -> DataFrame:
    """All rows as struct ``row`` with ``image``: size, hash and NPY tiles of the resized picture.

    A null, empty or damaged value has an error and no tiles; it never fails the job.
    """

    @F.pandas_udf(TILE_ROWS)
    def convert(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                image = decode(value)
            except BadMedia as e:
                rows.append((0, 0, 0, str(e), None, []))
                continue
            small = np.clip(np.round(area_resize(image, height, width)), 0, 65535).astype(image.dtype)
            found = [{"row": r, "col": c, "npy": b, "dhash": d} for r, c, b, d in tiles(small, tile)]
            rows.append((*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, None, dhash(image), found))
        return pd.DataFrame(rows, columns=["height", "width", "channels", "error", "dhash", "tiles"])

    return df.select(F.struct("*").alias("row"), convert(F.col(media_col)).alias("image"))


# --- texts as pictures -----------------------------------------------------------------------------


def as_ppm(text: Column) -> tuple[Column, Column]:
    """Bytes of the text, and a PPM that holds them, padded by blanks to whole rows of 64 pixels."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    rows = F.greatest(F.ceil(F.length(raw) / UNIT), F.lit(1)).cast("int")
    head = F.encode(F.concat(F.lit(f"P6\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "utf-8")
    return F.length(raw).cast("long"), F.concat(head, F.rpad(raw, rows * UNIT, F.lit(b"\x20")))


def facts(value: bytes) -> tuple:
    """What is read back from a stored picture: ``FACTS`` and its tiles."""
    image = decode(value)
    payload = image.tobytes()
    small = np.clip(np.round(area_resize(image, 64, 64)), 0, 255).astype(np.uint8)
    cut = tiles(small, 32)
    joined = hashlib.sha256(b"".join(t[2] for t in cut)).hexdigest()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), dhash(image), len(cut), joined, [dict(zip(("row", "col", "npy", "dhash"), t, strict=True)) for t in cut]


ARROW_FACTS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), TILE)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, media) as doc_id, n_bytes and the facts; tiles are large, so few rows leave at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            told = list(zip(*[facts(v.as_py()) for v in part.column("media")], strict=True))
            columns = [pa.array(list(c), t) for c, t in zip(told, ARROW_FACTS, strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *FACTS.names, "tiles"])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the facts of the picture that holds each whole text, and its NPY tiles.

    A null text is an empty one; rows that repeat have equal values; an empty table gives no rows.
    """
    size, media = as_ppm(F.col(text_col))
    stored = df.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), media.alias("media"))
    kind = stored.schema["doc_id"].dataType.simpleString()
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS.fields)
    return stored.mapInArrow(read_back, f"doc_id {kind}, n_bytes long, {named}, tiles {TILE_TYPE}")
