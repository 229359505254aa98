"""Photographs to readings, verdicts and calibrations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.functions import card, panels
from capturelake.functions.colour import hex_to_lab
from capturelake.operators import analyse, calibrate, frames, photos
from tests.render import homography, linear, photograph

SCHEMA = "capture_id long, width int, height int, data binary"
TUNGSTEN = (0.95, 0.75, 0.42)


def row(key, image):
    return key, image.shape[1], image.shape[0], bytearray(image.tobytes())


def shots():
    """(row, panel, stage, reason or outcome) of drawn captures."""
    purple, white = "#5a2a6e", "#efe7c8"
    far = homography(1.6, (200, 130))
    return [
        (row(1, photograph(purple)), "marquis", "complete", "marquis-purple"),
        (row(2, photograph(purple, TUNGSTEN)), "marquis", "complete", "marquis-purple"),
        (row(3, photograph(white, (0.62, 0.7, 0.92), homography(4.8, (60, 40), (0.0002, 0.0003), 0.3))), "marquis", "complete", "marquis-no-reaction"),
        (row(4, photograph("#1f4fa8", (0.9, 0.9, 0.8), gradient=0.3)), "cobalt-thiocyanate", "complete", "cobalt-blue"),
        (row(5, photograph("#00c853")), "simons", "complete", None),
        (row(6, photograph(purple, (0.4, 0.4, 0.4), blur=2)), "marquis", "quality", "out-of-focus"),
        (row(7, photograph(purple, h=far)), "marquis", "quality", "card-too-small"),
        (row(8, photograph(purple, gains=(1.7, 1.7, 1.7))), "marquis", "quality", "overexposed"),
        (row(9, photograph(purple, hide=(2,))), "marquis", "detection", None),
        (row(10, photograph(purple, key=False)), "marquis", "detection", "orientation-key-not-found"),
        (row(11, photograph(purple, size=(118, 300))), "marquis", "detection", "image-too-small"),
        (row(12, np.full((200, 200, 3), 180, np.uint8)), "marquis", "detection", "too-few-marker-candidates"),
        ((13, 20, 20, bytearray(7)), "marquis", "detection", "image-data-misfit"),
        ((14, 200, 200, None), "marquis", "detection", "no-image-data"),
        ((15, -1, 0, bytearray()), "marquis", "detection", "image-size-invalid"),
        ((16, None, 5, bytearray(5)), "marquis", "detection", "image-size-invalid"),
        (row(17, photograph(purple)), "no-such-panel", "complete", None),
        (row(18, photograph(purple, patches=dict.fromkeys((p[0] for p in card.patch_rows()), "#777777"))), "marquis", "correction", "singular-system"),
        (row(19, np.rot90(photograph(purple), 2)), "marquis", "complete", "marquis-purple"),
    ]


@pytest.fixture(scope="module")
def taken(spark):
    rows = shots()
    captures = [(r[0], r[0] % 3, panel) for r, panel, *_ in rows] + [(99, 0, "marquis")]
    return rows, spark.createDataFrame([r for r, *_ in rows], SCHEMA).repartition(3), spark.createDataFrame(captures, "capture_id long, card_serial long, panel_id string")


def test_verdicts_of_photographs(spark, taken):
    rows, shot, captures = taken
    got = {r.capture_id: r for r in photos.analyse_frames(shot, captures).collect()}
    assert len(got) == len(rows) + 1
    assert (got[99].stage, got[99].rejection_reason) == ("detection", "no-photograph")
    for (key, *_), panel, stage, what in rows:
        g = got[key]
        assert g.stage == stage, (key, g.stage, g.rejection_reason, g.issues)
        assert g.accepted == (stage == "complete")
        if stage == "complete":
            assert g.outcome_id == what, (key, g.outcome_id, g.ranked[:2])
        elif what:
            assert g.rejection_reason == what, (key, g.rejection_reason)
        if stage != "complete":
            assert g.category == "inconclusive" and g.rejection_reason
    assert got[17].inconclusive_reason == "unknown-panel" and got[5].inconclusive_reason == "no-reference-match"
    lab = hex_to_lab("#5a2a6e")
    for key in (1, 2, 19):
        assert max(abs(got[key][c] - v) for c, v in zip("Lab", lab, strict=True)) < 4
    assert got[2].mean_delta_e < 2 and got[2].max_delta_e < 5


def test_one_reading_of_a_frame_equals_the_parts(spark, taken):
    """The fused reader against detection by joins, regions and flattened cards, frame by frame."""
    _, shot, _ = taken
    read = {r.capture_id: r for r in photos.read_cards(shot).collect()}
    sound = frames.sound(shot)
    parts = {r.capture_id: r for r in frames.detect_frames(sound).collect()}
    assert set(read) - set(parts) == {13, 14, 15, 16}
    for key, want in parts.items():
        g = read[key]
        assert (g.detection_reason, g.candidates) == (want.reason, want.candidates), key
        if want.ok:
            assert g.card_to_image == pytest.approx(want.card_to_image, rel=1e-6, abs=1e-6)
            assert g.image_to_card == pytest.approx(want.image_to_card, rel=1e-6, abs=1e-6)
            assert (g.quad_aspect, g.orientation_contrast, g.card_coverage) == pytest.approx((want.quad_aspect, want.orientation_contrast, want.card_coverage))
    placed = sound.join(spark.createDataFrame([(k, list(map(float, r.card_to_image))) for k, r in parts.items() if r.ok], "capture_id long, h array<double>"), "capture_id")
    regions = frames.sample_regions(placed, [*card.sample_rows(), card.window_row()]).collect()
    found = {(k, p.patch_id): p for k, r in read.items() for p in r.patches or ()}
    assert len(regions) == len(found) == 13 * sum(r.ok for r in parts.values())
    for w in regions:
        p = found[w.capture_id, w.region_id]
        assert [p[n] for n in photos.REGION_NAMES] == pytest.approx([w[n] for n in photos.REGION_NAMES], abs=1e-6)
    flat = {r.capture_id: np.frombuffer(bytes(r.data), np.uint8).reshape(270, 445, 3) for r in frames.rectify(placed).collect()}
    for key, image in flat.items():
        assert read[key].focus_score == pytest.approx(photos.focus(image), rel=0.02)


def test_readings_are_the_drawn_colours(spark, taken):
    _, shot, _ = taken
    got = {r.patch_id: r for r in photos.card_readings(photos.read_cards(shot.filter("capture_id = 1"))).collect()}
    assert len(got) == card.ALL_PATCHES
    for p in card.patch_rows():
        assert [got[p[0]][c] for c in "rgb"] == pytest.approx(linear(p[11]).tolist(), abs=0.01)
        assert (got[p[0]].slot, got[p[0]].role, got[p[0]].ref_g) == (p[3], p[1], pytest.approx(p[16]))


def test_measured_references_are_used(spark, taken):
    """A card printed too dark, measured as it is, gives the right colour; by nominal references it does not."""
    _, _, captures = taken
    dark = {p[0]: "#%02x%02x%02x" % tuple(int(int(p[11][i : i + 2], 16) * 0.8) for i in (1, 3, 5)) for p in card.patch_rows()}
    shot = spark.createDataFrame([row(1, photograph("#5a2a6e", patches=dark)), row(3, photograph("#5a2a6e", patches=dark))], SCHEMA)
    measured = spark.createDataFrame([(1, k, *hex_to_lab(v)) for k, v in dark.items()], "card_serial long, patch_id string, L double, a double, b double")
    known = spark.createDataFrame([(1, "measured")], "card_serial long, provenance string")
    got = {r.capture_id: r for r in photos.analyse_frames(shot, captures.filter("capture_id in (1, 3)"), measured, known).collect()}
    assert got[1].is_fully_measured and not got[3].is_fully_measured
    lab = hex_to_lab("#5a2a6e")
    off = {k: max(abs(g[c] - v) for c, v in zip("Lab", lab, strict=True)) for k, g in got.items()}
    assert off[1] < 4 < off[3]
    assert "calibration-not-measured" in [i.code for i in got[3].issues] and "calibration-not-measured" not in [i.code for i in got[1].issues]


def test_cards_calibrate_from_photographs(spark):
    gains = [(1, 1, 1), (0.98, 0.98, 0.98), (0.96, 0.97, 0.96), (0.97, 0.96, 0.98)]
    rows = [row(i, photograph("#efe7c8", g)) for i, g in enumerate(gains)]
    rows += [row(10 + i, photograph("#efe7c8", g)) for i, g in enumerate([(1, 1, 1), (0.3, 0.3, 0.3), (0.9, 0.5, 0.2)])]
    rows += [row(20, photograph("#efe7c8")), row(21, photograph("#efe7c8", hide=(1,))), (22, 1, 1, None)]
    shot = spark.createDataFrame(rows, SCHEMA)
    serials = spark.createDataFrame([(r[0], r[0] // 10) for r in rows] + [(30, 3)], "capture_id long, card_serial long")
    got = {r.card_serial: r for r in photos.self_calibrate_frames(shot, serials).collect()}
    assert (got[0].ok, got[0].frame_count, got[0].provenance, len(got[0].patches)) == (True, 4, "self-measured", 12)
    assert (got[1].ok, got[1].reason) == (False, "frames-disagree")
    assert (got[2].ok, got[2].reason, got[2].frame_count) == (False, "too-few-frames", 1)
    assert (got[3].ok, got[3].reason, got[3].frame_count) == (False, "too-few-frames", 0)
    readings = photos.calibration_readings(shot, serials)
    want = {r.card_serial: r for r in calibrate.self_calibrate(readings).collect()}
    assert [tuple(p) for p in want[0].patches] == [tuple(p) for p in got[0].patches]
    white = next(p for p in got[0].patches if p.patch_id == "neutral-216")
    assert abs(white.L - hex_to_lab("#d8d8d8")[0]) < 2


def test_empty_and_repeated_photographs(spark, taken):
    _, shot, captures = taken
    assert photos.analyse_frames(shot.filter("false"), captures).filter("rejection_reason = 'no-photograph'").count() == captures.count()
    assert photos.analyse_frames(shot, captures.filter("false")).count() == 0
    twice = shot.filter("capture_id = 1").unionByName(shot.filter("capture_id = 1"))
    assert photos.analyse_frames(twice, captures.filter("capture_id = 1")).count() == 1


def test_records_of_photographed_captures(spark, taken):
    """Photographs to finished record text: the readers' columns are those that the record needs."""
    _, shot, captures = taken
    rows = captures.withColumns({"device_id": F.lit(7), "record_id": F.concat(F.lit("r"), "capture_id"), "captured_at": F.lit("2026-01-01T00:00:00.000Z")})
    cores = analyse.build_record_cores(photos.analyse_frames(shot, rows))
    import json

    made = {r.capture_id: json.loads(r.record_json) for r in cores.collect()}
    assert len(made) == rows.count()
    assert made[1]["result"]["outcomeId"] == "marquis-purple" and made[1]["measurement"]["correctionModel"] == "affine3x4"
    assert made[9]["captureAccepted"] is False and made[9]["measurement"]["sampleLab"] is None
    assert panels.PANELS[0] == made[1]["panelId"]
