"""Card detection on pixel tables: dark blobs, marker candidates, quads of four, orientation, validation."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from capturelake.functions.card import MARKERS
from capturelake.functions.geometry import apply_homography, fit_homography, invert_homography, polygon_signed_area
from capturelake.operators.pixels import bilinear_probe

KEY = "capture_id"
#: Limits of markers and quads.
AREA_SHARE, MOST_ASPECT, SOLIDITY = (0.0002, 0.06), 1.5, (0.68, 1.35)
CANDIDATES, QUADS = 14, 40
MOST_AREA_RATIO, QUAD_ASPECT, LEAST_CONTRAST, AREA_AGREEMENT = 4.0, (0.9, 3.6), 0.18, (0.5, 2.0)
LEAST_FRAME = 120
MARKER_ASPECT = (MARKERS[1][0] - MARKERS[0][0]) / (MARKERS[2][1] - MARKERS[1][1])
MARKER_SIZE = 8.0
KEY_INNER = 1 / 3


def labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of 8-connected pixels: runs along rows that touch are joined, each under the first, until nothing changes. Labels rise
    with the first pixel, by rows."""
    order = None
    if not len(x):
        return np.empty(0, np.int64)
    if np.any((y[1:] < y[:-1]) | (y[1:] == y[:-1]) & (x[1:] < x[:-1])):
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    left = int(x.min())
    span = int(x.max()) - left + 4
    row = y[first].astype(np.int64) * span
    low, high = row + x[first] - left + 1, row + x[last] - left + 1
    start, end = np.searchsorted(high, low - span - 1), np.searchsorted(low, high - span + 1, "right")  # runs of the row above
    n = np.maximum(end - start, 0)
    one = np.repeat(np.arange(len(first)), n)
    other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    parent = np.arange(len(first))
    while True:
        a, b = parent[one], parent[other]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    found = parent[np.cumsum(new) - 1]
    if order is None:
        return found
    out = np.empty(len(x), np.int64)
    out[order] = found
    return out


def dark_blobs(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(capture_id, x, y, blob_id): 8-connected parts of the pixels no brighter than their capture's threshold. Whole captures
    are labelled together, many to a batch, one under the other; blob ids are unique within a capture."""
    dark = pixels.join(thresholds, KEY).filter("luma <= threshold").select(KEY, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = held[KEY] != held[KEY].iloc[-1]
            if whole.any():
                yield named(held[whole])
                held = held[~whole]
        if held is not None and len(held):
            yield named(held)

    def named(frame):
        capture, tall = pd.factorize(frame[KEY])[0], int(frame["y"].max() - frame["y"].min()) + 3
        y = frame["y"].to_numpy() - int(frame["y"].min()) + capture * tall
        return frame.assign(blob_id=labels(frame["x"].to_numpy(), y))

    return dark.repartition(KEY).sortWithinPartitions(KEY).mapInPandas(run, StructType([*dark.schema, StructField("blob_id", LongType())]))


def blob_moments(labelled: DataFrame) -> DataFrame:
    """Area, box, centroid, fill ratio, aspect and solidity by second moments (with 1/12 for square pixels) of each blob."""
    s = labelled.groupBy(KEY, "blob_id").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"),
        F.avg(F.col("x") * F.col("y")).alias("xy"),
    )
    return moments(s)


def moments(s: DataFrame, *more: str) -> DataFrame:
    """Fill ratio, aspect and solidity of blobs given by area, box and means of x, y and their products."""
    c = F.col
    s = s.withColumns({"m20": c("xx") - c("cx") * c("cx") + 1 / 12, "m02": c("yy") - c("cy") * c("cy") + 1 / 12, "m11": c("xy") - c("cx") * c("cy")})
    s = s.withColumns({"mid": (c("m20") + c("m02")) / 2, "off": F.sqrt(F.pow((c("m20") - c("m02")) / 2, F.lit(2)) + c("m11") * c("m11"))})
    small = c("mid") - c("off")
    aspect = F.when(small > 1e-9, F.sqrt((c("mid") + c("off")) / F.when(small > 1e-9, small))).otherwise(float("inf"))
    solid = c("area") / (12 * F.sqrt(F.greatest((c("mid") + c("off")) * small, F.lit(1e-12))))
    fill = c("area") / ((c("max_x") - c("min_x") + 1) * (c("max_y") - c("min_y") + 1))
    return s.select(KEY, "blob_id", "area", "min_x", "max_x", "min_y", "max_y", "cx", "cy", fill.alias("fill_ratio"), aspect.alias("aspect"), solid.alias("solidity"), *more)


def best_markers(blobs: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Blobs that may be markers, the ``most`` largest of each capture, ranked (i). Needs the size of the frame in which they
    were found, working_width and working_height."""
    share = F.col("area") / (F.col("working_width") * F.col("working_height"))
    good = share.between(*AREA_SHARE) & (F.col("aspect") <= MOST_ASPECT) & F.col("solidity").between(*SOLIDITY)
    ranked = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("area"), "blob_id"))
    return blobs.filter(good).withColumn("i", ranked).filter(F.col("i") <= most)


def marker_candidates(blobs: DataFrame, frames: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """``best_markers`` of blobs of frames (capture_id, width, height) at full size."""
    sizes = frames.select(KEY, F.col("width").alias("working_width"), F.col("height").alias("working_height"), F.lit(1.0).alias("scale"))
    return best_markers(blobs.join(sizes, KEY), most)


def best_fours(x: np.ndarray, y: np.ndarray, area: np.ndarray, most: int = QUADS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(capture's row, rank, score, candidates' numbers in order round their middle) of the best convex fours of captures that have
    as many candidates each, one row of x, y and area a capture; best first."""
    m, n = x.shape
    plain = np.array(list(combinations(range(n), 4)), np.int64).reshape(-1, 4)
    px, py = x[:, plain], y[:, plain]
    angle = np.arctan2(py - py.mean(2, keepdims=True), px - px.mean(2, keepdims=True))
    fours = np.take_along_axis(np.broadcast_to(plain, angle.shape), np.lexsort((py, px, angle), axis=2), axis=2)
    at = np.arange(m)[:, None, None]
    px, py, own = x[at, fours], y[at, fours], area[at, fours]
    dx, dy = (np.roll(c, -1, axis=2) - c for c in (px, py))
    turn = dx * np.roll(dy, -1, axis=2) - dy * np.roll(dx, -1, axis=2)
    side = np.hypot(dx, dy)
    one, two = (side[..., 0] + side[..., 2]) / 2, (side[..., 1] + side[..., 3]) / 2
    long, short = np.maximum(one, two), np.minimum(one, two)
    ratio = own.max(2) / own.min(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        aspect = long / short
        uneven = (np.abs(side[..., 0] - side[..., 2]) + np.abs(side[..., 1] - side[..., 3])) / long
        score = 3 * np.abs(np.log(aspect / MARKER_ASPECT)) + 2 * uneven + np.log(ratio) - 0.35 * np.log(long * short)
    convex = (turn.max(2) >= 1e-9) != (turn.min(2) <= -1e-9)
    row, k = np.nonzero(convex & (ratio <= MOST_AREA_RATIO) & (short > 0) & (aspect >= QUAD_ASPECT[0]) & (aspect <= QUAD_ASPECT[1]))
    score, fours = score[row, k], fours[row, k]
    order = np.lexsort((*fours.T[::-1], score, row))
    row, score, fours = row[order], score[order], fours[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    good = rank < most
    return row[good], rank[good] + 1, score[good], fours[good]


#: Fours of captures that are tried at once.
TOGETHER = 50_000


def candidate_quads(candidates: DataFrame, most: int = QUADS) -> DataFrame:
    """(capture_id, rank, score, corners): the best convex fours of a capture's candidates, in order round their centre, in
    pixels of the full size.

    A capture's candidates, at most 14, meet in one row; captures of as many candidates are tried together, at most 1001 fours each."""
    blob = F.struct("i", (F.col("cx") / F.col("scale")).alias("x"), (F.col("cy") / F.col("scale")).alias("y"), (F.col("area") / (F.col("scale") * F.col("scale"))).alias("area"))
    own = candidates.groupBy(KEY).agg(F.sort_array(F.collect_list(blob)).alias("blobs")).filter(F.size("blobs") >= 4)
    schema = StructType([candidates.schema[KEY], *_parse_datatype_string("rank int, score double, corners array<struct<x:double,y:double,i:int,area:double>>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            blobs = batch.column(1)
            keys, sizes = batch.column(0), pc.list_value_length(blobs).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            i, x, y, area = (c.to_numpy(zero_copy_only=False) for c in blobs.flatten().flatten())
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                step = max(1, TOGETHER // comb(int(n), 4))
                for first in range(0, len(rows), step):
                    part = rows[first : first + step]
                    cells = starts[part][:, None] + np.arange(n)
                    row, rank, score, fours = best_fours(x[cells], y[cells], area[cells], most)
                    if not len(row):
                        continue
                    at = cells[row[:, None], fours].ravel()
                    corners = pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.array(i[at], pa.int32()), pa.array(area[at])], fields=list(arrow.field("corners").type.value_type))
                    corners = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, 4), pa.int32()), corners, type=arrow.field("corners").type)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(part[row])), pa.array(rank, pa.int32()), pa.array(score), corners], schema=arrow)

    return own.mapInArrow(run, schema)


def orientation_contrast(candidates: DataFrame, pixels: DataFrame) -> DataFrame:
    """(capture_id, i, contrast): brightness of a blob's middle less that of four places round it, each a 5 x 5 grid at full
    resolution; 0 where either cannot be read."""
    wide, high = (F.col("max_x") - F.col("min_x") + 1) / F.col("scale"), (F.col("max_y") - F.col("min_y") + 1) / F.col("scale")
    places = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for p, dx, dy in ((0, 0.0, 0.0), (1, -0.36, 0.0), (2, 0.36, 0.0), (3, 0.0, -0.36), (4, 0.0, 0.36))))
    half = KEY_INNER * 0.3
    probes = candidates.select(KEY, "i", (F.col("cx") / F.col("scale")).alias("x"), (F.col("cy") / F.col("scale")).alias("y"), wide.alias("w"), high.alias("h"), F.explode(places).alias("p"))
    probes = probes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(24))))
    gx, gy = (F.col("cell") % 5) / 4 * 2 - 1, F.floor(F.col("cell") / 5) / 4 * 2 - 1
    px = F.col("x") + F.col("p.dx") * F.col("w") + gx * half * F.col("w")
    py = F.col("y") + F.col("p.dy") * F.col("h") + gy * half * F.col("h")
    points = probes.select(KEY, "i", F.col("p.p").alias("part"), F.concat_ws(":", "i", "p.p", "cell").alias("point_id"), px.alias("px"), py.alias("py"))
    boxes = bilinear_probe(points, pixels).groupBy(KEY, "i", "part").agg(F.avg("luma").alias("mean"))
    both = boxes.groupBy(KEY, "i").agg(F.max(F.when(F.col("part") == 0, F.col("mean"))).alias("inner"), F.avg(F.when(F.col("part") > 0, F.col("mean"))).alias("ring"))
    return both.select(KEY, "i", F.coalesce(F.col("inner") - F.col("ring"), F.lit(0.0)).alias("contrast"))


def detect_cards(pixels: DataFrame, frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``judged`` on pixel tables at full size; ``frames`` (capture_id, width, height) has a row for each."""
    candidates = marker_candidates(blob_moments(dark_blobs(pixels, thresholds)), frames)
    return judged(frames, candidates, orientation_contrast(candidates, pixels))


def judged(frames: DataFrame, candidates: DataFrame, contrast: DataFrame) -> DataFrame:
    """One row a frame: ok, or the reason of failure; homography card -> image and back, aspect, contrast, coverage.

    Quads are tried in order of score and the first that passes every test counts; else the first quad's failure does. Frames
    under 120 pixels, with under four candidates or without a plausible quad fail before that."""
    counts = candidates.groupBy(KEY).agg(F.count("*").alias("candidates"))
    quads = candidate_quads(candidates)
    parts = quads.select(KEY, "rank", F.posexplode("corners").alias("at", "b")).select(KEY, "rank", "at", F.col("b.i").alias("i"))
    keyed = parts.join(contrast, [KEY, "i"]).groupBy(KEY, "rank").agg(F.max_by(F.struct("at", "contrast"), F.struct("contrast", (-F.col("i")).alias("n"))).alias("k"))
    rows = quads.join(keyed, [KEY, "rank"]).select(KEY, "rank", "corners", F.col("k.at").alias("at"), F.col("k.contrast").alias("contrast"))
    corner = lambda d: F.get("corners", F.pmod(F.col("at") + d, F.lit(4)).cast("int"))
    away = lambda d: F.hypot(corner(d)["x"] - corner(0)["x"], corner(d)["y"] - corner(0)["y"])
    ahead = away(1) >= away(3)
    named = F.array(corner(0), F.when(ahead, corner(1)).otherwise(corner(3)), corner(2), F.when(ahead, corner(3)).otherwise(corner(1)))
    rows = rows.withColumn("markers", named).withColumn("set_id", F.concat_ws(":", KEY, "rank"))
    pairs = rows.select("set_id", F.posexplode("markers").alias("m", "b")).select(
        "set_id", *(F.get(F.array(*(F.lit(p[k]) for p in MARKERS)), "m").alias(n) for k, n in ((0, "sx"), (1, "sy"))), F.col("b.x").alias("dx"), F.col("b.y").alias("dy")
    )
    rows = rows.join(fit_homography(pairs), "set_id").withColumn("inverse", invert_homography(F.col("h")))
    agree = F.lit(True)
    for m, (x, y) in enumerate(MARKERS):
        r = MARKER_SIZE / 2
        square = [apply_homography(F.col("h"), F.lit(x + sx * r), F.lit(y + sy * r)) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        area = F.abs(polygon_signed_area(F.array(*(F.struct(p.alias("x"), q.alias("y")) for p, q in square))))
        agree = agree & F.coalesce((F.get("markers", F.lit(m))["area"] / F.when(area > 0, area)).between(*AREA_AGREEMENT), F.lit(True))
    reason = F.when(F.col("contrast") < LEAST_CONTRAST, "orientation-key-not-found").when(F.col("inverse").isNull(), "degenerate-homography").when(~agree, "marker-size-implausible")
    rows = rows.withColumn("reason", reason)
    side = lambda i: F.hypot(F.get("markers", F.lit(i))["x"] - F.get("markers", F.lit(0))["x"], F.get("markers", F.lit(i))["y"] - F.get("markers", F.lit(0))["y"])
    area = F.abs(polygon_signed_area(F.transform("markers", lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y")))))
    rows = rows.select(KEY, "rank", "reason", "h", "inverse", "contrast", (side(1) / F.when(side(3) > 0, side(3))).alias("aspect"), area.alias("area"))
    best = rows.groupBy(KEY).agg(F.min_by(F.struct("reason", "h", "inverse", "contrast", "aspect", "area"), F.struct(F.col("reason").isNotNull(), F.col("rank"))).alias("q"))
    done = frames.join(counts, KEY, "left").join(best, KEY, "left")
    why = (
        F.when(F.least("width", "height") < LEAST_FRAME, "image-too-small").when(F.coalesce("candidates", F.lit(0)) < 4, "too-few-marker-candidates")
        .when(F.col("q").isNull(), "no-plausible-quad").otherwise(F.col("q.reason"))
    )
    good = why.isNull()
    keep = lambda c: F.when(good, c)
    return done.select(
        KEY, good.alias("ok"), why.alias("reason"), F.coalesce("candidates", F.lit(0)).alias("candidates"), keep(F.col("q.h")).alias("card_to_image"),
        keep(F.col("q.inverse")).alias("image_to_card"), keep(F.col("q.aspect")).alias("quad_aspect"), keep(F.col("q.contrast")).alias("orientation_contrast"),
        keep(F.col("q.area") / (F.col("width") * F.col("height"))).alias("card_coverage"),
    )


