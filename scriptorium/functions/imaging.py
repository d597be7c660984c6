"""Pixel kernels over (height, width, pixels) columns: pixels is the binary of a gray image, row by row.

Models, fonts and drawing are external; these are the measures and transforms that the tables need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of pixels that are worked on, and sent back, at once: batches of rows are cut into such parts.
PIXELS = 2 << 20


def _parts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Rows of a batch whose first column, pixels, has some ``PIXELS`` bytes together; a larger image is a part of its own. Empty batches are one part."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while True:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIXELS, side="right"))) if len(upto) else 0
        yield tuple(c.slice(lo, hi - lo) for c in columns)
        lo = hi
        if lo >= len(upto):
            return


def _image(data: bytes | None, h: int | None, w: int | None) -> np.ndarray | None:
    if data is None or not h or not w or len(data) < h * w:
        return None
    return np.frombuffer(data, dtype=np.uint8, count=h * w).reshape(h, w)


def ink_share(img: np.ndarray | None) -> float:
    """Share of black pixels; 0 without pixels."""
    return float((img == 0).mean()) if img is not None and img.size else 0.0


def otsu(img: np.ndarray) -> int:
    """Level that parts the histogram into two classes of greatest variance between them; the first on ties."""
    n = np.bincount(img.ravel(), minlength=256).astype(np.float64)
    below, total = n.cumsum(), n.sum()
    moment = (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (moment[-1] * below - total * moment) ** 2 / (below * (total - below))
    return int(np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax())


def blurred(img: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian (1 2 1), mirrored at the edges."""
    x = np.pad(img.astype(np.float64), 1, mode="reflect" if min(img.shape) > 1 else "edge")
    x = x[:-2] + 2 * x[1:-1] + x[2:]
    return np.floor((x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 16 + 0.5).astype(np.uint8)


def binary(img: np.ndarray, method: str = "otsu_gaussian", level: int = 127) -> tuple[int, np.ndarray]:
    """(level, black-and-white image) by method otsu, otsu_gaussian or fixed."""
    if method not in ("otsu", "otsu_gaussian", "fixed"):
        raise ValueError(f"unknown method: {method}")
    img = blurred(img) if method == "otsu_gaussian" else img
    t = level if method == "fixed" else otsu(img)
    return t, (img > t).astype(np.uint8) * np.uint8(255)


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def linear(img: np.ndarray, gain: float = 2.0, shift: float = -150.0) -> np.ndarray:
    """|gain * x + shift|, rounded half to even and kept within a byte."""
    return np.clip(np.rint(np.abs(img.astype(np.float64) * gain + shift)), 0, 255).astype(np.uint8)


def equalized(img: np.ndarray, clip: float = 3.0, tiles: tuple[int, int] = (3, 3)) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each of ``tiles`` (across, down) has its histogram cut at ``clip`` times the mean, what
    was cut is spread evenly, and a pixel blends the curves of the four nearest tiles."""
    across, down = tiles
    h, w = img.shape
    x = np.pad(img, ((0, -h % down), (0, -w % across)), mode="reflect" if min(h, w) > max(tiles) else "edge")
    th, tw = x.shape[0] // down, x.shape[1] // across
    area, limit = th * tw, max(1, int(clip * th * tw / 256))
    curves = np.zeros((down, across, 256))
    for i in range(down):
        for j in range(across):
            n = np.bincount(x[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[:: max(256 // rest, 1)][:rest] += 1
            curves[i, j] = np.clip(np.rint(n.cumsum() * (255.0 / area)), 0, 255)

    def near(size: int, step: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / step - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, count - 1), np.clip(low + 1, 0, count - 1), at - low

    y0, y1, fy = near(h, th, down)
    x0, x1, fx = near(w, tw, across)
    fy, fx = fy[:, None], fx[None, :]
    top = curves[y0[:, None], x0[None, :], img] * (1 - fx) + curves[y0[:, None], x1[None, :], img] * fx
    low = curves[y1[:, None], x0[None, :], img] * (1 - fx) + curves[y1[:, None], x1[None, :], img] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def line_pixels(a: tuple[float, float], b: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a straight line of pixels between two points, both included."""
    n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
    return np.rint(np.linspace(a[1], b[1], n)).astype(int), np.rint(np.linspace(a[0], b[0], n)).astype(int)


def polygon_mask(h: int, w: int, points: list) -> np.ndarray:
    """True inside a polygon (even-odd rule) and on its edges; points are whole pixels (x, y) and may lie outside."""
    pts = [(int(x), int(y)) for x, y in points]
    out, y = np.zeros((h, w), dtype=bool), np.arange(h)[:, None]
    cols = np.arange(w)[None, :]
    for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1], strict=True):
        if y0 != y1:
            inside = (y >= min(y0, y1)) & (y < max(y0, y1))
            out ^= inside & (cols < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
        r, c = line_pixels(a, b)
        ok = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        out[r[ok], c[ok]] = True
    return out


def cropped(img: np.ndarray, points: list, kind: str = "polygon") -> np.ndarray:
    """The part of an image under a boundary: the bounding box without its last row and column, or what the polygon holds, on black."""
    if kind not in ("rectangle", "polygon"):
        raise ValueError(f"unknown crop: {kind}")
    xs, ys = zip(*((int(x), int(y)) for x, y in points), strict=True)
    more = 1 if kind == "polygon" else 0
    box = slice(max(0, min(ys)), max(0, max(ys) + more)), slice(max(0, min(xs)), max(0, max(xs) + more))
    if kind == "polygon":
        mask = polygon_mask(*img.shape[:2], points)
        img = np.where(mask if img.ndim == 2 else mask[..., None], img, 0)
    return np.ascontiguousarray(img[box])


def overlaid(img: np.ndarray, marks: list[tuple[list | None, list | None]]) -> np.ndarray:
    """A colour image of a gray page with its (baseline, boundary) lines: baselines of two points red and two wide, boundaries blue."""
    out = np.repeat(img[..., None], 3, axis=2)

    def draw(a, b, colour, wide):
        r, c = line_pixels(a, b)
        for d in range(wide):
            ok = (r + d >= 0) & (r + d < out.shape[0]) & (c >= 0) & (c < out.shape[1])
            out[r[ok] + d, c[ok]] = colour

    for base, bound in marks:
        if base and len(base) == 2:
            draw(base[0], base[1], (255, 0, 0), 2)
        for a, b in zip(bound or [], [*(bound or [])[1:], *(bound or [])[:1]], strict=True):
            draw(a, b, (0, 0, 255), 1)
    return out


def png(img: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) image as a PNG file."""
    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = img.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), dtype=np.uint8), img.reshape(h, -1)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def zone_mask(h: int, w: int, boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """255 everywhere but 0 in the boxes, corners included; they may overlap and reach beyond the page."""
    out = np.full((h, w), 255, dtype=np.uint8)
    for box in boxes:
        x1, y1, x2, y2 = (max(0, int(v)) for v in box)
        out[y1 : y2 + 1, x1 : x2 + 1] = 0
    return out


def fitted(img: np.ndarray, w: int, h: int, left: int, top: int, size: int) -> np.ndarray:
    """Resized by a windowed sinc (three lobes) and centred on black in a square."""
    def weights(src: int, dst: int) -> np.ndarray:
        scale = max(src / dst, 1.0)
        x = (np.arange(src)[None, :] + 0.5 - (np.arange(dst)[:, None] + 0.5) * src / dst) / scale
        k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
        return k / k.sum(axis=1, keepdims=True)

    out = np.zeros((size, size), dtype=np.uint8)
    small = weights(img.shape[0], h) @ img.astype(np.float64) @ weights(img.shape[1], w).T
    out[top : top + h, left : left + w] = np.clip(np.floor(small + 0.5), 0, 255).astype(np.uint8)
    return out


def line_measures(images: DataFrame) -> DataFrame:
    """(folder, stem, density, size, height, width) of gray line images (folder, stem, height, width, pixels). Images
    without pixels have density 0 and keep their own stem."""

    @F.arrow_udf("double")
    def density(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, h, w in (p for batch in parts for p in _parts(batch)):
            yield pa.array([ink_share(_image(*x)) for x in zip(data.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True)])

    size = (F.coalesce(F.col("height"), F.lit(0)) * F.coalesce(F.col("width"), F.lit(0))).cast("long")
    return images.select("folder", "stem", density("pixels", "height", "width").alias("density"), size.alias("size"), "height", "width")


def binarized(images: DataFrame, method: str = "otsu_gaussian", level: int = 127) -> DataFrame:
    """``images`` with threshold and black-and-white pixels; null where there is no image."""
    binary(np.zeros((1, 1), dtype=np.uint8), method)

    @F.arrow_udf("struct<threshold:int,pixels:binary>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, h, w in (p for batch in parts for p in _parts(batch)):
            out = [(None if img is None else binary(img, method, level)) for img in (_image(*x) for x in zip(data.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True))]
            yield pa.array([None if o is None else {"threshold": o[0], "pixels": o[1].tobytes()} for o in out], pa.struct([("threshold", pa.int32()), ("pixels", pa.binary())]))

    done = images.withColumn("_b", run("pixels", "height", "width"))
    return done.withColumns({"threshold": F.col("_b.threshold"), "pixels": F.col("_b.pixels")}).drop("_b")


def _each(images: DataFrame, kind: str, of: Callable, *inputs: str):
    """A column that ``of`` (image, further values) gives for every row; null where there is no image."""

    @F.arrow_udf(kind)
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        shape = pa.list_(pa.float32()) if kind.startswith("array") else pa.binary()
        for cols in (p for batch in parts for p in _parts(batch)):
            rows = zip(*(c.to_pylist() for c in cols), strict=True)
            yield pa.array([None if (img := _image(*r[:3])) is None else of(img, *r[3:]) for r in rows], shape)

    return run("pixels", "height", "width", *inputs)


def enhanced(images: DataFrame, method: str = "clahe", **settings) -> DataFrame:
    """``images`` with pixels of more contrast, by method clahe or linear."""
    if method not in ("clahe", "linear"):
        raise ValueError(f"unknown method: {method}")
    kernel = equalized if method == "clahe" else linear
    return images.withColumn("pixels", _each(images, "binary", lambda img: kernel(img, **settings).tobytes()))


def standardized(images: DataFrame, mean: float = 0.0, std: float = 1.0, name: str = "values") -> DataFrame:
    """``images`` with ``name``: pixels as shares of 255, less ``mean``, over ``std`` (array<float>, row by row)."""
    values = ((np.arange(256) / 255.0 - mean) / std).astype(np.float32)
    return images.withColumn(name, _each(images, "array<float>", lambda img: values[img.ravel()]))


def channel_sums(images: DataFrame) -> DataFrame:
    """(pixels, weight): how many pixels of each level all images have, for mean and deviation over a whole set of images."""

    @F.arrow_udf("array<float>")
    def levels(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for cols in (p for batch in parts for p in _parts(batch)):
            rows = zip(*(c.to_pylist() for c in cols), strict=True)
            yield pa.array([None if (img := _image(*r)) is None else np.bincount(img.ravel(), minlength=256).astype(np.float32) for r in rows], pa.list_(pa.float32()))

    each = images.select(F.posexplode(levels("pixels", "height", "width")).alias("pixels", "n")).filter("n > 0")
    return each.groupBy("pixels").agg(F.sum("n").alias("weight"))


def png_files(images: DataFrame) -> DataFrame:
    """(folder, stem, content): gray images as PNG files."""
    return images.select("folder", "stem", _each(images, "binary", png).alias("content"))


def crop_files(images: DataFrame, lines: DataFrame, kind: str = "polygon") -> DataFrame:
    """(folder, stem, content): a PNG file for each line (imagename, idx, boundary) of the images (stem, height, width, pixels) of that name."""
    rows = images.withColumnRenamed("stem", "imagename").join(lines.select("imagename", "idx", "boundary"), "imagename").filter(F.size("boundary") > 0)
    content = _each(rows, "binary", lambda img, points: png(cropped(img, points, kind)), "boundary")
    return rows.select(F.col("imagename").alias("folder"), F.concat_ws("_", "imagename", F.lit("line"), F.col("idx").cast("string")).alias("stem"), content.alias("content"))


def mask_files(pages: DataFrame, zones: DataFrame, kind: str) -> DataFrame:
    """(stem, content): a PNG mask of every page (image, height, width), 0 in the zones (image, class, x1, y1, x2, y2) of the class, else 255."""
    z = zones.filter(F.col("class") == kind).groupBy("image").agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))).alias("boxes"))

    @F.arrow_udf("binary")
    def draw(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for cols in parts:
            yield pa.array([None if not h or not w else png(zone_mask(h, w, boxes or [])) for h, w, boxes in zip(*(c.to_pylist() for c in cols), strict=True)], pa.binary())

    return pages.join(z, "image", "left").select(F.col("image").alias("stem"), draw("height", "width", "boxes").alias("content"))


def overlay_files(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(stem, content): a PNG of each page (stem, height, width, pixels) with the baselines and boundaries of its lines (imagename, idx, baseline, boundary)."""
    marks = lines.groupBy(F.col("imagename").alias("stem")).agg(F.sort_array(F.collect_list(F.struct("idx", "baseline", "boundary"))).alias("marks"))
    rows = images.join(marks, "stem", "left")
    return rows.select("stem", _each(rows, "binary", lambda img, m: png(overlaid(img, [(x["baseline"], x["boundary"]) for x in m or []])), "marks").alias("content"))
