"""Photographs as rows (capture_id, width, height, data: 8-bit red, green, blue by rows): what is read off a whole frame.

A frame stays in its row and is read in place, in Arrow batches; only blobs, regions and flattened cards leave. The same
measures on pixel tables are in ``pixels`` and ``detect``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from capturelake.functions import card
from capturelake.operators import detect
from capturelake.operators.pixels import BINS, BRIGHT_END, DARK_END, TRIM
from capturelake.shared import kept

KEY = "capture_id"
WORKING_SIZE = 640
RECTIFIED = (445, 270)
WEIGHTS = np.array([0.2126, 0.7152, 0.0722])
#: About so many bytes of rows leave a task together.
BATCH_BYTES = 1 << 21
#: Places of a flattened card that are read at once.
BLOCK = 4096
REGION = ", ".join(f"{n}{c} double" for n in ("", "raw_", "std_") for c in "rgb") + ", clipped_fraction double, out_fraction double, count long"


def misfit(width: Column, height: Column, data: Column) -> Column:
    """Why a frame cannot be read: null where its bytes are those of its size."""
    return (
        F.when(data.isNull(), "no-image-data").when(width.isNull() | height.isNull() | (F.least(width, height) <= 0), "image-size-invalid")
        .when(F.octet_length(data) != 3 * width.cast("long") * height, "image-data-misfit")
    )


def sound(frames: DataFrame) -> DataFrame:
    """The frames that can be read; ``quarantined`` has the others."""
    return frames.filter(misfit(F.col("width"), F.col("height"), F.col("data")).isNull())


def quarantined(frames: DataFrame) -> DataFrame:
    """(capture_id, error) of the frames that cannot be read."""
    return frames.select(KEY, misfit(F.col("width"), F.col("height"), F.col("data")).alias("error")).filter("error is not null")


def _map_frames(df: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Rows that ``each(key, image, *other columns)`` yields, frame by frame; frames that cannot be read have none."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            for at in range(batch.num_rows):
                key, width, height, data, *more = (c[at].as_py() for c in batch.columns)
                for row in each(key, np.frombuffer(data, np.uint8).reshape(height, width, 3), *more):
                    rows.append(row)
                    size += 1000 + sum(len(v) for v in row if isinstance(v, bytes))
                if size >= BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return sound(df).mapInArrow(run, kind)


def downscaled(image: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """Block means by a whole factor that brings the longer side to ``most``, as 8-bit levels (halves to the even one), and the
    scale that results."""
    height, width = image.shape[:2]
    factor = -(-max(height, width) // most)
    if factor <= 1:
        return image, 1.0
    h, w = max(1, height // factor), max(1, width // factor)
    blocks = image[: h * factor, : w * factor].reshape(h, factor, w, factor, 3).mean((1, 3))
    return np.rint(blocks).astype(np.uint8), w / width


def otsu_threshold(luma: np.ndarray) -> float:
    """Midpoint of the class means at the first best split of a 256-bin histogram, over 255; 0.5 if nothing is parted."""
    bins = np.bincount(np.minimum(BINS - 1, np.floor(luma.ravel() * 255 + 0.5)).astype(np.int64), minlength=BINS).astype(float)
    n, s = np.cumsum(bins), np.cumsum(bins * np.arange(BINS))
    use = (bins > 0) & (n < n[-1])
    if not use.any():
        return 0.5
    w0, s0 = n[use], s[use]
    m0, m1 = s0 / w0, (s[-1] - s0) / (n[-1] - w0)
    best = int(np.argmax(w0 * (n[-1] - w0) * (m0 - m1) ** 2))
    return float((m0[best] + m1[best]) / 2 / 255)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray, planes: np.ndarray | None = None) -> np.ndarray:
    """Levels 0..1 blended from four pixels at each place, one row a place; NaN outside the frame. ``planes`` are the image's channels,
    one row each, where they are there already."""
    height, width = image.shape[:2]
    with np.errstate(invalid="ignore"):
        inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
    px, py = np.where(inside, x, 0.0), np.where(inside, y, 0.0)
    x0, y0 = px.astype(np.int64), py.astype(np.int64)
    fx, fy = px - x0, py - y0
    gx, gy = 1 - fx, 1 - fy
    right, below = np.where(x0 + 1 < width, 1, 0), np.where(y0 + 1 < height, width, 0)
    first = y0 * width + x0
    corners = (first, first + right, first + below, first + below + right)
    out = np.empty((image.shape[2], len(px)))
    for c, plane in enumerate(np.ascontiguousarray(image.reshape(-1, image.shape[2]).T) if planes is None else planes):
        a, b, d, e = (plane[at] for at in corners)
        out[c] = (a * gx * gy + b * fx * gy + d * gx * fy + e * fx * fy) / 255
    out = out.T
    out[~inside] = np.nan
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers nearest to numbers from 0 up, halves upwards."""
    whole = np.floor(x)
    return whole + (x - whole >= 0.5)


def mapped(h: list[float], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places under a homography; NaN where its denominator is under 1e-12 in size."""
    w = h[6] * x + h[7] * y + h[8]
    w = np.where(np.abs(w) >= 1e-12, w, np.nan)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def _blobs(image: np.ndarray, most: int) -> tuple[dict[str, np.ndarray], float, tuple[int, int]]:
    """Sums of an image's dark blobs at working size (area, box, means of x, y and their products), the scale, and that size."""
    small, scale = downscaled(image, most)
    luma = ((small.astype(float) @ WEIGHTS) / 255).astype(np.float32)
    y, x = np.nonzero(luma <= otsu_threshold(luma))
    if not len(x):
        return {}, scale, small.shape[1::-1]
    found = detect.labels(x, y)
    there = np.zeros(found.max() + 1, bool)
    there[found] = True
    blob = (np.cumsum(there) - 1)[found]
    area = np.bincount(blob)
    out = {"area": area}
    for name, at, start, v in (("min_x", np.minimum, 1 << 30, x), ("max_x", np.maximum, -1, x), ("min_y", np.minimum, 1 << 30, y), ("max_y", np.maximum, -1, y)):
        out[name] = np.full(len(area), start)
        at.at(out[name], blob, v)
    for name, w in (("cx", x), ("cy", y), ("xx", x * x), ("yy", y * y), ("xy", x * y)):
        out[name] = np.bincount(blob, weights=w) / area
    return out, scale, small.shape[1::-1]


def frame_blobs(frames: DataFrame, most: int = WORKING_SIZE) -> DataFrame:
    """Dark blobs of each frame at working size, with the measures of ``detect.blob_moments``, and the scale."""

    def each(key, image):
        blobs, scale, size = _blobs(image, most)
        columns = [c.tolist() for c in blobs.values()]
        for i, row in enumerate(zip(*columns, strict=True)):
            yield key, i, *row, float(scale), *size

    schema = f"{KEY} {frames.schema[KEY].dataType.simpleString()}, blob_id long, area long, min_x long, max_x long, min_y long, max_y long, cx double, cy double, xx double, yy double, xy double, scale double, working_width int, working_height int"
    found = _map_frames(frames.select(KEY, "width", "height", "data").filter(F.least("width", "height") >= detect.LEAST_FRAME), each, schema)
    return detect.moments(found, "scale", "working_width", "working_height")


def _contrasts(image: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Brightness of each blob's middle less that of four places round it; 0 where either cannot be read."""
    grid = np.linspace(-1, 1, 5) * (detect.KEY_INNER * 0.3)
    px = x[:, None, None] + w[:, None, None] * (np.array([0, -0.36, 0.36, 0, 0])[:, None] + np.tile(grid, 5))
    py = y[:, None, None] + h[:, None, None] * (np.array([0, 0, 0, -0.36, 0.36])[:, None] + np.repeat(grid, 5))
    luma = (bilinear(image, px.ravel(), py.ravel()) @ WEIGHTS).reshape(px.shape)
    there = ~np.isnan(luma)
    with np.errstate(invalid="ignore"):
        means = np.where(there, luma, 0).sum(2) / there.sum(2)
        ring = np.where(np.isnan(means[:, 1:]), 0, means[:, 1:]).sum(1) / (~np.isnan(means[:, 1:])).sum(1)
    return np.nan_to_num(means[:, 0] - ring, nan=0.0)


def _candidates(blobs: dict[str, np.ndarray], size: tuple[int, int]) -> dict[str, np.ndarray]:
    """The blobs that may be markers, largest first (of equal ones the first)."""
    cx, cy = blobs["cx"], blobs["cy"]
    m20, m02, m11 = blobs["xx"] - cx * cx + 1 / 12, blobs["yy"] - cy * cy + 1 / 12, blobs["xy"] - cx * cy
    mid, off = (m20 + m02) / 2, np.sqrt(((m20 - m02) / 2) ** 2 + m11 * m11)
    small = mid - off
    aspect = np.where(small > 1e-9, np.sqrt((mid + off) / np.where(small > 1e-9, small, 1)), np.inf)
    solidity = blobs["area"] / (12 * np.sqrt(np.maximum((mid + off) * small, 1e-12)))
    share = blobs["area"] / (size[0] * size[1])
    inside = lambda x, ends: (x >= ends[0]) & (x <= ends[1])
    good = np.flatnonzero(inside(share, detect.AREA_SHARE) & (aspect <= detect.MOST_ASPECT) & inside(solidity, detect.SOLIDITY))
    order = good[np.argsort(-blobs["area"][good], kind="stable")][: detect.CANDIDATES]
    return {k: v[order] for k, v in blobs.items()}


def _marks(image: np.ndarray, found: dict[str, np.ndarray], scale: float) -> np.ndarray:
    """The contrasts of a frame's candidates."""
    return _contrasts(image, found["cx"] / scale, found["cy"] / scale, *((found[f"max_{c}"] - found[f"min_{c}"] + 1) / scale for c in "xy"))


def frame_markers(frames: DataFrame, most: int = WORKING_SIZE) -> DataFrame:
    """``detect.best_markers`` of the blobs of each frame (i, area, cx, cy, scale), with their orientation contrast, in one reading."""

    def each(key, image):
        blobs, scale, size = _blobs(image, most)
        found = _candidates(blobs, size) if blobs else {"area": ()}
        if len(found["area"]):
            columns = (found[n].tolist() for n in ("area", "cx", "cy"))
            for i, row in enumerate(zip(*columns, _marks(image, found, scale).tolist(), strict=True)):
                yield key, i + 1, *row[:3], float(scale), row[3]

    schema = f"{KEY} {frames.schema[KEY].dataType.simpleString()}, i int, area long, cx double, cy double, scale double, contrast double"
    return _map_frames(frames.select(KEY, "width", "height", "data").filter(F.least("width", "height") >= detect.LEAST_FRAME), each, schema)


def orientation_contrast(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """(capture_id, i, contrast): ``detect.orientation_contrast`` on frames, at full resolution. A frame's few candidates ride on
    its row."""
    box = F.struct("i", (F.col("cx") / F.col("scale")).alias("x"), (F.col("cy") / F.col("scale")).alias("y"), ((F.col("max_x") - F.col("min_x") + 1) / F.col("scale")).alias("w"), ((F.col("max_y") - F.col("min_y") + 1) / F.col("scale")).alias("h"))
    own = candidates.groupBy(KEY).agg(F.collect_list(box).alias("boxes"))

    def each(key, image, boxes):
        own = _contrasts(image, *(np.array([b[n] for b in boxes]) for n in "xywh"))
        for b, contrast in zip(boxes, own.tolist(), strict=True):
            yield key, b["i"], contrast

    joined = frames.select(KEY, "width", "height", "data").join(own, KEY).select(KEY, "width", "height", "data", "boxes")
    return _map_frames(joined, each, f"{KEY} {frames.schema[KEY].dataType.simpleString()}, i int, contrast double")


def detect_frames(frames: DataFrame, most: int = WORKING_SIZE, sizes: DataFrame | None = None) -> DataFrame:
    """``detect.detect_cards`` on frames: blobs are sought at working size, orientation marks are read at full resolution, and
    the homography is in full-size pixels. Frames are read once, where they are, and their candidates kept; ``sizes`` (capture_id, width,
    height) spares a second look at frames that are dear to make."""
    marks = kept(frame_markers(frames, most), "markers")
    return detect.judged((frames if sizes is None else sizes).select(KEY, "width", "height"), marks.drop("contrast"), marks.select(KEY, "i", "contrast"))


def _regions(image: np.ndarray, h: list[float], rects: list[tuple], nx: int, ny: int, trim: float) -> Iterator[tuple]:
    """(region, trimmed mean, raw mean and deviation of linear light, clipped and out-of-frame shares, count) of each region."""
    u, v = np.tile((np.arange(nx) + 0.5) / nx, ny), np.repeat((np.arange(ny) + 0.5) / ny, nx)
    for region, x, y, width, height in rects:
        levels = bilinear(image, *mapped(h, x + u * width, y + v * height))
        levels = levels[~np.isnan(levels[:, 0])]
        n = len(levels)
        if not n:
            yield region, *([0.0] * 9), 1.0, 1.0, 0
            continue
        clipped = ((levels <= DARK_END) | (levels >= BRIGHT_END)).any(1).mean()
        linear = np.where(levels <= 0.04045, levels / 12.92, ((levels + 0.055) / 1.055) ** 2.4)
        cut = int(n * trim)
        inner = np.sort(linear, axis=0)[cut : n - cut] if n > 2 * cut else linear
        yield region, *inner.mean(0).tolist(), *linear.mean(0).tolist(), *linear.std(0).tolist(), float(clipped), 1 - n / (nx * ny), n


def sample_regions(frames: DataFrame, rects: list[tuple], nx: int = 24, ny: int = 16, trim: float = TRIM) -> DataFrame:
    """Regions (region_id, x, y, width, height in card millimetres) of each frame, whose homography is column ``h``: trimmed
    mean, raw mean and deviation of linear light, clipped and out-of-frame shares, count. A region of which nothing is in the
    frame has zeroes, is all out, and counts as clipped."""

    def each(key, image, h):
        for row in _regions(image, h, rects, nx, ny, trim):
            yield key, *row

    schema = f"{KEY} {frames.schema[KEY].dataType.simpleString()}, region_id string, {REGION}"
    return _map_frames(frames.select(KEY, "width", "height", "data", "h").filter("h is not null"), each, schema)


def _flat(image: np.ndarray, h: list[float], size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The card from the front as 8-bit levels, black outside the frame, and where it is inside."""
    width, height = size
    x = np.tile((np.arange(width) + 0.5) / width * card.WIDTH, height)
    y = np.repeat((np.arange(height) + 0.5) / height * card.HEIGHT, width)
    flat, there = np.empty((len(x), 3), np.uint8), np.empty(len(x), bool)
    planes = np.ascontiguousarray(image.reshape(-1, 3).T)
    for first in range(0, len(x), BLOCK):
        part = slice(first, first + BLOCK)
        levels = bilinear(image, *mapped(h, x[part], y[part]), planes)
        there[part] = ~np.isnan(levels[:, 0])
        flat[part] = rounded(np.where(there[part, None], levels, 0) * 255)
    return flat.reshape(height, width, 3), there


def rectify(frames: DataFrame, size: tuple[int, int] = RECTIFIED) -> DataFrame:
    """(capture_id, width, height, data, inside): the card of each frame seen from the front, as 8-bit levels, read by the
    inverse map of column ``h``; black outside the frame, of which ``inside`` is the share of places that are not."""

    def each(key, image, h):
        flat, there = _flat(image, h, size)
        yield key, *size, flat.tobytes(), float(there.mean())

    schema = f"{KEY} {frames.schema[KEY].dataType.simpleString()}, width int, height int, data binary, inside double"
    return _map_frames(frames.select(KEY, "width", "height", "data", "h").filter("h is not null"), each, schema)
