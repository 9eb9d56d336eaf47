"""Image files of all readable forms, and what known changes do to their hashes."""

import struct
import zlib

import numpy as np

from feria.sources import images


def png(px, kind=2, filters=(0,), palette=None, alpha=None):
    """A PNG file of samples (rows, columns, n), lines filtered in turn as the format says."""
    h, w, n = px.shape
    lines, above = [], np.zeros(w * n, int)
    for y in range(h):
        f, x = filters[y % len(filters)], px[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(n, int), x[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * x, left, above, (left + above) // 2, near][f]
        lines.append(bytes([f]) + ((x - guess) % 256).astype(np.uint8).tobytes())
        above = x
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = zlib.compress(b"".join(lines))
    extra = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", alpha) if alpha else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", data[:40]) + chunk(b"IDAT", data[40:]) + chunk(b"IEND", b"")


def grey_of(px):
    """Nine by eight means by repeating each pixel, so that all areas are whole."""
    h, w, _ = px.shape
    big = np.repeat(np.repeat(px.astype(float), 8, 0), 9, 1)
    small = np.floor(big.reshape(8, h, 9, w, 3).mean(axis=(1, 3)) + 0.5)
    return np.floor(small @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(int).ravel().tolist()


def test_forms():
    rng = np.random.default_rng(3)
    for h, w in ((8, 9), (1, 1), (5, 7), (31, 40), (64, 50)):
        px = rng.integers(0, 256, (h, w, 3))
        want = grey_of(px)
        assert images.grey_values(png(px, filters=(0, 1, 2, 3, 4))) == want
        assert images.grey_values(b"P6\n# a remark\n%d %d\n255\n" % (w, h) + px.astype(np.uint8).tobytes()) == want
        opaque = np.concatenate([px, np.full((h, w, 1), 255)], axis=2)
        assert images.grey_values(png(opaque, 6, (4, 3))) == want
        grey = px[..., :1]
        assert images.grey_values(png(grey, 0, (4, 1))) == images.grey_values(b"P5 %d %d 255 " % (w, h) + grey.astype(np.uint8).tobytes()) == grey_of(np.repeat(grey, 3, 2))
        kinds = rng.integers(0, 4, (h, w, 1))
        colours = np.array([[0, 0, 0], [255, 0, 9], [10, 200, 30], [77, 77, 255]])
        assert images.grey_values(png(kinds, 3, (2,), colours.astype(np.uint8).tobytes())) == grey_of(colours[kinds[..., 0]])
        assert images.grey_values(png(kinds, 3, (0,), colours.astype(np.uint8).tobytes(), b"\xff\x00")) == grey_of(np.where(kinds == 1, 0, colours[kinds[..., 0]]))


def test_hashes_of_files(spark, tmp_path):
    """A larger copy, a brighter one and another form keep the hash; a mirrored image does not; what is no image has none."""
    x = np.tile(np.array([10, 40, 50, 90, 30, 60, 20, 80, 70]), (8, 1)) + np.arange(8)[:, None]
    px = np.repeat(x[..., None], 3, 2)
    large = np.repeat(np.repeat(px, 5, 0), 7, 1)
    (tmp_path / "more").mkdir()
    files = {"a.png": png(px), "more/large.png": png(large, filters=(4, 2)), "bright.png": png(px + 60), "a.ppm": b"P6 9 8 255\n" + px.astype(np.uint8).tobytes(), "mirror.png": png(px[:, ::-1]), "cut.png": png(px)[:60], "empty.png": b"", "text.png": b"no image", "deep.png": png(px).replace(b"\x08\x02\x00\x00\x00", b"\x10\x02\x00\x00\x00")}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.image_hash for r in images.hashes(spark, str(tmp_path)).collect()}
    row = "".join("1" if a >= b else "0" for a, b in zip(x[0], x[0][1:]))
    assert got["a.png"] == got["large.png"] == got["bright.png"] == got["a.ppm"] == f"{int(row * 8, 2):016x}" and len(got) == len(files) - 1
    assert got["mirror.png"] not in (None, got["a.png"])
    assert {k for k, v in got.items() if v is None} == {"cut.png", "text.png", "deep.png"}
    odd = spark.createDataFrame([(1, None, "x"), (2, bytearray(files["a.png"]), None), (3, bytearray(), None)], "`the id` long, content binary, _px2 string")
    assert {r["the id"]: r.image_hash for r in images.with_hash(odd).collect()} == {1: None, 2: got["a.png"], 3: None}
    assert images.with_hash(odd.where("false")).collect() == []


def test_grey_values_are_computed_once(spark):
    """Values that are an expression stand in the plan once, and not for each of the 128 places that the hash reads."""
    from pyspark.sql import functions as F

    from feria.functions import text

    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("id") * (i + 7) * 31 + i * i) % 251)
    rows = spark.range(2000).select("id", text.difference_hash(px).alias("h"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("% 251") == 1
    got = {r.id: r.h for r in rows.collect()}
    for k in (0, 1, 7, 1999):
        v = [(k * (i + 7) * 31 + i * i) % 251 for i in range(72)]
        bits = "".join("1" if v[i // 8 * 9 + i % 8] >= v[i // 8 * 9 + i % 8 + 1] else "0" for i in range(64))
        assert got[k] == f"{int(bits, 2):016x}"
    assert spark.range(1).select(text.difference_hash(F.array(F.lit(1))).alias("h")).first().h is None
