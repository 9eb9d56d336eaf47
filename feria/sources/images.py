"""Hashes of image files: Spark lists and reads the files, tasks decode them to nine by eight grey values, and the hash is an
expression over these (`text.difference_hash`)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.functions import text

_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by a PNG file's kind of colour: grey, colour, palette, grey with alpha, colour with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Shares of red, green and blue in a grey value.
_GREY = np.array([0.299, 0.587, 0.114])


class Unreadable(ValueError):
    """A file that is no image of a known form, or a broken one."""


def _line(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line of bytes without its filter; n bytes a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Unreadable("filter")
    out, up = line.tolist(), above.tolist()
    for i, x in enumerate(out):
        a, b, c = (out[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
        if kind == 4:  # the neighbour that is nearest to what left, above and their corner foretell
            guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
        else:
            guess = (a + b) // 2
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def _png(raw: bytes) -> np.ndarray:
    """Colours (rows, columns, 3) of a PNG file of eight bits a sample, not interlaced; what is transparent is black."""
    at, data, palette, alpha, head = len(_PNG), [], None, b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in _SAMPLES or head[6] or not head[0] or not head[1]:
        raise Unreadable("form")
    width, height, kind, n = head[0], head[1], head[3], _SAMPLES[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * n + 1)
    out, above = np.empty((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for y in range(height):
        out[y] = above = _line(int(lines[y, 0]), lines[y, 1:], above, n)
    px = out.reshape(height, width, n)
    if kind == 3:
        seen = np.full(len(palette), 255, np.uint8)
        seen[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        return palette[px[..., 0]] * (seen[px[..., 0]][..., None] / 255)
    shown = px[..., -1:] / 255 if n in (2, 4) else 1.0
    return (np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]) * shown


def _netpbm(raw: bytes) -> np.ndarray:
    """Colours of a binary grey or colour map of eight bits a sample (P5 or P6)."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        begin = at
        while raw[at : at + 1].isdigit():
            at += 1
        fields.append(int(raw[begin:at]))
    width, height, most = fields
    n = 3 if raw[:2] == b"P6" else 1
    if not 0 < most < 256 or not width or not height:
        raise Unreadable("form")
    px = np.frombuffer(raw, np.uint8, width * height * n, at + 1).reshape(height, width, n) * (255 / most)
    return np.repeat(px, 3 // n, axis=2)


def _means(px: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means of n equally wide strips along an axis; a pixel on a border counts to both sides by its share."""
    size = px.shape[axis]
    edges = np.arange(n + 1) * size / n
    sums = np.insert(np.cumsum(px, axis=axis, dtype=float), 0, 0.0, axis=axis)
    whole = np.minimum(edges.astype(int), size - 1)
    shape = [-1 if i == axis else 1 for i in range(px.ndim)]
    upto = np.take(sums, whole, axis=axis) + np.take(px, whole, axis=axis) * (edges - whole).reshape(shape)
    return np.diff(upto, axis=axis) * (n / size)


def grey_values(raw: bytes | None) -> list[int] | None:
    """72 grey values, eight rows of nine, of an image file: means of its areas. Null if it cannot be read."""
    try:
        px = _png(raw) if raw.startswith(_PNG) else _netpbm(raw) if raw[:2] in (b"P5", b"P6") else None
    except (AttributeError, IndexError, TypeError, ValueError, struct.error, zlib.error):  # no file, or a broken one
        return None
    if px is None:
        return None
    small = np.floor(_means(_means(px, 8, 0), 9, 1) + 0.5)
    return np.floor(small @ _GREY + 0.5).astype(int).ravel().tolist()


def with_hash(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds image_hash to rows with image files as binary values: PNG of eight bits a sample without interlacing, and binary
    grey and colour maps. Null, empty and broken files and other forms have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(content)
            for i in range(batch.num_rows):  # one file at a time: they may be large
                part = batch.slice(i, 1)
                px = pa.array([grey_values(part.column(at)[0].as_py())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != at), px], names=[*(n for k, n in enumerate(part.schema.names) if k != at), "_px"])

    kept = [f for f in rows.schema.fields if f.name != content]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_px array<int>"])
    return rows.mapInArrow(run, schema).withColumn("image_hash", text.difference_hash(F.col("_px"))).drop("_px")


def hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and image_hash of all files below a folder whose name fits a pattern; Spark leaves empty files out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return with_hash(files.select("path", "content"))
