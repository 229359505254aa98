"""Photographs to verdicts: each frame is read once, in its row, and leaves as one small row of what was seen.

A row's reader finds the card, samples the twelve patches and the sample's window, and measures focus on the flattened card.
What it gives is kept in the shared folder, since the fit, the gates and the verdict all read it; the frames themselves are
neither shuffled nor kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import card
from capturelake.functions.geometry import fit_one
from capturelake.operators import analyse, calibrate, detect, frames
from capturelake.operators.pixels import TRIM
from capturelake.shared import kept

KEY = "capture_id"
GRID = (24, 16)
READ = (
    "detection_reason string, candidates int, card_to_image array<double>, image_to_card array<double>, quad_aspect double, orientation_contrast double, "
    f"card_coverage double, focus_score double, patches array<struct<patch_id:string,{frames.REGION.replace(' ', ':').replace(',:', ',')}>>"
)
REGION_NAMES = [x.split()[0] for x in frames.REGION.split(", ")]


def _area(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def _fitted(corners: np.ndarray, area: np.ndarray, contrast: np.ndarray) -> tuple[str | None, dict]:
    """A quad's failure, or none, and its homography and measures. Corners come in order round the middle."""
    key = int(np.argmax(contrast))
    if contrast[key] < detect.LEAST_CONTRAST:
        return "orientation-key-not-found", {}
    turn = (key + np.arange(4)) % 4
    if np.hypot(*(corners[turn[1]] - corners[key])) < np.hypot(*(corners[turn[3]] - corners[key])):
        turn = turn[[0, 3, 2, 1]]
    markers, area = corners[turn], area[turn]
    h = fit_one(np.array(card.MARKERS), markers)
    m = None if h is None else np.array(h).reshape(3, 3)
    if m is None or abs(np.linalg.det(m)) < 1e-14 or abs((inverse := np.linalg.inv(m))[2, 2] * np.linalg.det(m)) < 1e-12:
        return "degenerate-homography", {}
    half = detect.MARKER_SIZE / 2
    for (x, y), a in zip(card.MARKERS, area, strict=True):
        expected = _area(np.column_stack(frames.mapped(h, x + half * np.array([-1, 1, 1, -1]), y + half * np.array([-1, -1, 1, 1]))))
        if expected > 0 and not detect.AREA_AGREEMENT[0] <= a / expected <= detect.AREA_AGREEMENT[1]:
            return "marker-size-implausible", {}
    short = np.hypot(*(markers[3] - markers[0]))
    return None, {
        "h": h, "inverse": (inverse / inverse[2, 2]).ravel().tolist(), "contrast": float(contrast[key]), "area": _area(markers),
        "aspect": float(np.hypot(*(markers[1] - markers[0])) / short) if short > 0 else 0.0,
    }


def find_card(image: np.ndarray, most: int = frames.WORKING_SIZE) -> tuple[str | None, int, dict]:
    """(reason of failure or none, candidates, homography and measures): the tests of ``detect.judged`` on one frame."""
    if min(image.shape[:2]) < detect.LEAST_FRAME:
        return "image-too-small", 0, {}
    blobs, scale, size = frames._blobs(image, most)
    if not blobs or len((found := frames._candidates(blobs, size))["area"]) < 4:
        return "too-few-marker-candidates", len(found["area"]) if blobs else 0, {}
    x, y, area = found["cx"] / scale, found["cy"] / scale, found["area"] / (scale * scale)
    quads = detect.best_fours(x[None], y[None], area[None])[3]
    if not len(quads):
        return "no-plausible-quad", len(x), {}
    contrast = frames._marks(image, found, scale)
    first = None
    for q in quads:
        reason, seen = _fitted(np.column_stack([x[q], y[q]]), area[q], contrast[q])
        if reason is None:
            return None, len(x), seen
        first = first or reason
    return first, len(x), {}


def focus(flat: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian of brightness over inner pixels, times 1e4."""
    luma = flat @ frames.WEIGHTS / 255
    if min(luma.shape) < 3:
        return 0.0
    inner = 4 * luma[1:-1, 1:-1] - luma[:-2, 1:-1] - luma[2:, 1:-1] - luma[1:-1, :-2] - luma[1:-1, 2:]
    return float(inner.var() * 1e4)


def read_cards(photos: DataFrame, grid: tuple[int, int] = GRID, trim: float = TRIM) -> DataFrame:
    """One row for each photograph (capture_id, width, height, data): why no card was found, or its homography and measures,
    focus, and ``patches``, the readings of the twelve patches and, last, of the sample's window. A photograph that
    cannot be read keeps its row, with the reason of ``frames.misfit``."""
    rects = [*card.sample_rows(), card.window_row()]

    def each(key, image):
        reason, count, seen = find_card(image)
        if reason is not None:
            yield key, reason, count, *([None] * 7)
            return
        h = seen["h"]
        patches = [dict(zip(("patch_id", *REGION_NAMES), row, strict=True)) for row in frames._regions(image, h, rects, *grid, trim)]
        share = seen["area"] / (image.shape[0] * image.shape[1])
        yield key, None, count, h, seen["inverse"], seen["aspect"], seen["contrast"], share, focus(frames._flat(image, h, frames.RECTIFIED)[0]), patches

    rows = photos.select(KEY, "width", "height", "data")
    read = frames._map_frames(rows, each, f"{KEY} {photos.schema[KEY].dataType.simpleString()}, {READ}")
    bad = frames.quarantined(rows).withColumnRenamed("error", "detection_reason")
    return read.unionByName(bad, allowMissingColumns=True)


def card_readings(read: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Patch readings of ``read_cards`` with place, role and reference colour of each patch; ``references`` (capture_id, patch_id, ref_r,
    ref_g, ref_b) stand in for nominal colours where they are given."""
    patches = card.card_patches(read.sparkSession).select("patch_id", "slot", "role", "ramp_pos", "u", "v", "ref_r", "ref_g", "ref_b")
    rows = read.filter("patches is not null").select(KEY, F.explode("patches").alias("p")).select(KEY, "p.*").filter("patch_id != 'sample'")
    rows = rows.join(F.broadcast(patches), "patch_id")
    if references is None:
        return rows
    own = references.select(KEY, "patch_id", *(F.col(f"ref_{c}").alias(f"own_{c}") for c in "rgb"))
    joined = rows.join(own, [KEY, "patch_id"], "left")
    return joined.withColumns({f"ref_{c}": F.coalesce(f"own_{c}", f"ref_{c}") for c in "rgb"}).drop(*(f"own_{c}" for c in "rgb"))


def _references(captures: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured colours of each capture's card as linear light."""
    from capturelake.functions.colour import lab_to_linear_rgb

    linear = lab_to_linear_rgb(tuple(map(F.col, "Lab")))
    rows = measured.select("card_serial", "patch_id", *(c.alias(f"ref_{n}") for c, n in zip(linear, "rgb", strict=True)))
    return captures.select(KEY, "card_serial").join(rows, "card_serial").drop("card_serial")


def analyse_frames(photos: DataFrame, captures: DataFrame, measured: DataFrame | None = None, calibrations: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """``analyse.analyse_captures`` from photographs: one row for each capture, whatever became of it.

    ``photos`` have capture_id, width, height and data; ``captures`` capture_id, panel_id and whatever a record needs. With ``measured``
    (card_serial, patch_id, L, a, b) and ``calibrations`` (card_serial, provenance), a capture's card_serial picks its references
    and says how far they were measured; otherwise they are nominal. A capture whose card is not found, whose photograph
    cannot be read or is missing has stage detection and the reason. Of several photographs of a capture one counts."""
    read = kept(read_cards(photos).dropDuplicates([KEY]), "read-cards")
    own = read.withColumn("sample", F.element_at("patches", -1)).select(
        KEY, F.coalesce("detection_reason", F.when(F.col("patches").isNull(), "no-photograph")).alias("detection_reason"), "quad_aspect", "orientation_contrast", "card_coverage",
        "focus_score", "card_to_image", "candidates", *(F.col(f"sample.{n}{c}").alias(f"sample_{n}{c}") for n in ("", "raw_", "std_") for c in "rgb"), F.lit(True).alias("photographed"),
    )
    rows = captures.join(own, KEY, "left")
    reason = F.when(F.col("photographed").isNull(), "no-photograph").otherwise(F.col("detection_reason"))
    rows = rows.withColumn("detection_reason", reason).withColumn("detection_ok", F.col("detection_reason").isNull()).drop("photographed")
    if measured is None or calibrations is None:
        rows = rows.withColumns({"has_per_patch_references": F.lit(False), "is_fully_measured": F.lit(False)})
        return analyse.analyse_captures(card_readings(read), rows, outcomes)
    status = card.calibration_status(calibrations, measured, card.card_patches(read.sparkSession)).drop("provenance", "patches")
    rows = rows.join(status, "card_serial", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_per_patch_references", "is_fully_measured")})
    return analyse.analyse_captures(card_readings(read, _references(captures, measured)), rows, outcomes)


def calibration_readings(photos: DataFrame, shots: DataFrame) -> DataFrame:
    """Readings of calibration photographs for ``calibrate.self_calibrate``: ``shots`` (capture_id, card_serial) says whose card each shows.
    Photographs without a card give none, and so do not count as frames."""
    rows = card_readings(kept(read_cards(photos), "calibration-cards")).join(shots.select(KEY, "card_serial"), KEY)
    return rows.select("card_serial", F.col(KEY).alias("frame_id"), F.col("slot").alias("reading_pos"), "patch_id", "slot", "r", "g", "b")


def self_calibrate_frames(photos: DataFrame, shots: DataFrame, least_frames: int = calibrate.LEAST_FRAMES, most: float = calibrate.MOST_DISAGREEMENT) -> DataFrame:
    """``calibrate.self_calibrate`` from photographs; a card none of whose photographs shows a card is refused for too few frames."""
    done = calibrate.self_calibrate(calibration_readings(photos, shots), least_frames, most)
    rows = shots.select("card_serial").distinct().join(done, "card_serial", "left")
    return rows.withColumns({"frame_count": F.coalesce("frame_count", F.lit(0).cast("long")), "ok": F.coalesce("ok", F.lit(False)), "reason": F.when(F.col("frame_count").isNull(), "too-few-frames").otherwise(F.col("reason"))})
