"""Media columns: Netpbm and BMP images to arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, table

_TOKEN = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = [*fields, 1][:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if not n:
        raise ValueError("an image without samples")
    if n > 8 * len(data):
        raise ValueError("truncated Netpbm image")
    if kind == b"P1":  # digits may touch each other
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8) - 48
        return ((1 - bits[:n]) * 255).astype(np.uint8).reshape(height, width, 1)
    if kind in (b"P2", b"P3"):
        plain = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:n], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).astype(np.uint8)[..., None]
    elif kind in (b"P5", b"P6"):
        plain = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    else:
        raise ValueError("not a Netpbm image")
    if plain.size != n:
        raise ValueError("truncated Netpbm image")
    plain = plain.reshape(height, width, depth)
    return plain if most == 255 and plain.dtype == np.uint8 else (plain.astype(np.int64) * 255 // max(1, most)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, head = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    width, height = (int.from_bytes(data[18 + 4 * i : 22 + 4 * i], "little", signed=True) for i in range(2))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if head < 40 or packing or bits not in (1, 8, 24, 32) or width < 1 or not height:
        raise ValueError("this kind of BMP isn't supported")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if height > 0:  # bottom row first
        rows = rows[::-1]
    if bits > 8:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]
    index = np.unpackbits(rows, axis=1)[:, :width] if bits == 1 else rows[:, :width]
    used = int.from_bytes(data[46:50], "little") or 2**bits
    colours = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
    return colours[index]


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or uncompressed BMP image as uint8 of shape (height, width, channels)."""
    return _bmp(data) if data[:2] == b"BM" else _netpbm(data)


def pgm(samples: np.ndarray) -> bytes:
    """Samples of shape (height, width) as a binary grey map."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each target cell, from the integral image read between its samples."""
    h, w = image.shape[:2]
    total = np.zeros((h + 1, w + 1, image.shape[2]))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def read(table: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    at = read(read(total, np.arange(height + 1) * h / height, 0), np.arange(width + 1) * w / width, 1)
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells * (height * width) / (h * w)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 by 9 area means is below its right neighbour."""
    grey = area_resize(image.mean(axis=2, keepdims=True) if image.shape[2] > 1 else image, 8, 9)[..., 0]
    return np.packbits(np.round(grey[:, :-1], 6) < np.round(grey[:, 1:], 6)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def media_tiles(media: DataFrame, column: str = "media", side: int = 32) -> DataFrame:
    """media with height, width, channels, tile (NPY bytes of the image resized to side by side,
    uint8), dhash (hex) and error, one image at a time.

    Null and broken images give nulls and say why in error. Input columns with these names are
    replaced, all others stay, whatever their names; repeats repeat; an empty table gives no rows.
    """
    names = ("height", "width", "channels", "tile", "dhash", "error")

    def each(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            try:
                if data is None:
                    raise ValueError("no image")
                image = decode(bytes(data))
                small = np.round(area_resize(image, side, side)).astype(np.uint8)
                rows.append((*image.shape, npy(small), difference_hash(image), None))
            except (ValueError, IndexError, OverflowError) as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in names[:3]})

    tile = F.pandas_udf(each, "height int, width int, channels int, tile binary, dhash string, error string")
    return media.select(as_row(media, *names), tile(F.col(column)).alias("_tile")).select("_row.*", "_tile.*")


WIDTH = 64


def text_images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as grey maps 64 samples wide, and what is read back from the stored bytes."""
    for pdf in (some.iloc[at : at + 512] for some in batches for at in range(0, len(some), 512)):
        rows = []
        for text in pdf["text"]:
            data = b"" if text is None else text.encode("utf-8", "surrogatepass")
            payload = np.zeros(max(1, -(-len(data) // WIDTH)) * WIDTH, np.uint8)
            payload[: len(data)] = np.frombuffer(data, np.uint8)
            media = pgm(payload.reshape(-1, WIDTH))
            image = decode(media)
            back = image.tobytes()
            tile = npy(np.round(area_resize(image, 32, 32)).astype(np.uint8)[..., 0])
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), media, tile, difference_hash(image)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "tile", "dhash"]
        yield pdf[["doc_id"]].join(pd.DataFrame(rows, columns=names, index=pdf.index))


def texts_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (PGM bytes), tile (NPY
    bytes of 32 by 32 area means) and dhash of every whole text.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of 64 (null: empty),
    stored as one 8-bit sample each. What is reported is computed from the stored bytes after
    decoding them. Equal texts give equal values; repeated rows repeat; an empty table gives no
    rows; columns other than doc_id and text play no part.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tile binary, dhash string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(text_images, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts_as_media() of all documents; nulls, empty texts, repeats, an empty table and
    further columns as stated there; rows don't depend on each other, so there are no ties."""
    out = texts_as_media(table(spark, sf_dir, "documents"))
    feature = F.concat(F.col("dhash"), F.lit(":"), F.substring(F.sha2("tile", 256), 1, 16))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
